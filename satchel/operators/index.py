"""A stored search index that follows the archive: segments of postings by gram, tombstones, compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import log_rows, spread
from .search import BUCKETS, COLUMNS, _bucket, build_postings, search, search_documents

_LOG = "segment long, since long, batch string"


class SearchIndex:
    """A folder of segments. Each holds the search documents that one change has brought, their postings in BUCKETS folders by a hash of the gram, and the ids that it makes
    stale in the segments before it. A segment counts once the log, written last, names it; so a change that dies half way leaves the index as it was, and
    comes again under the same number. A batch that the log has is not applied twice.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, what: str, schema: str | None = None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.option("basePath", f"{self.path}/{what}").parquet(f"{self.path}/{what}/segment=*")

    def log(self) -> list:
        """(segment, since, batch) in order; since: the first segment that still counts. As many rows as changes."""
        return sorted(log_rows(self.spark, f"{self.path}/log", _LOG), key=lambda r: r.segment)

    def _write(self, docs: DataFrame, gone: DataFrame, batch: str | None, *, whole: bool = False) -> int:
        log = self.log()
        n = log[-1].segment + 1 if log else 0
        since = n if whole or not log else log[-1].since
        put = lambda df: df.write.mode("overwrite")
        put(docs).parquet(f"{self.path}/docs/segment={n}")
        kept = self.spark.read.parquet(f"{self.path}/docs/segment={n}")
        postings = build_postings(spread(kept, "doc_id")).withColumn("bucket", _bucket(F.col("gram")))
        put(postings.repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "gram")).partitionBy("bucket").parquet(f"{self.path}/postings/segment={n}")
        put(gone.select("doc_id").distinct()).parquet(f"{self.path}/gone/segment={n}")
        self.spark.createDataFrame([(n, since, batch)], _LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        return n

    def create(self, docs: DataFrame) -> int:
        """A first or new segment of all search documents (T2); what was there before no longer counts."""
        return self._write(docs, docs.select("doc_id").limit(0), None, whole=True)

    def update(self, links: DataFrame, link_tags: DataFrame, tags: DataFrame, touched: DataFrame, batch: str | None = None) -> bool:
        """Take in what has become of the touched links (id): changed, new and deleted ones alike. links, link_tags and tags are the archive after
        a merge (M1, M6, M8 to M10); only touched rows of them become search documents. False if the batch had been applied."""
        if batch is not None and any(r.batch == batch for r in self.log()):
            return False
        ids = touched.select("id").distinct()
        docs = search_documents(links.join(ids, "id", "left_semi"), link_tags.join(ids.withColumnRenamed("id", "link_id"), "link_id", "left_semi"), tags)
        self._write(docs, ids.select(F.col("id").alias("doc_id")), batch)
        return True

    def _live(self, what: str) -> DataFrame:
        """Rows of a kind that no later segment makes stale. Stale ids are few next to postings until compact(): the last one of each id is what a row is held against."""
        since = self.log()[-1].since
        last = self.log()[-1].segment
        rows = self._read(what).where(F.col("segment").between(since, last))
        stale = self._read("gone").where(F.col("segment").between(since, last)).groupBy(F.col("doc_id").alias("__id")).agg(F.max("segment").alias("__until"))
        return rows.join(stale, F.col("doc_id") == F.col("__id"), "left").where(F.col("__until").isNull() | (F.col("segment") >= F.col("__until"))).drop("__id", "__until", "segment")

    def docs(self) -> DataFrame:
        return self._live("docs").select("doc_id", *COLUMNS, "created_at")

    def postings(self) -> DataFrame:
        """gram, doc_id, col, bucket of the live documents; a search reads the folders and row groups of the grams it asks for."""
        return self._live("postings").select("gram", "doc_id", "col", "bucket")

    def compact(self) -> int:
        """Write what is live as one segment."""
        return self._write(self.docs(), self.docs().select("doc_id").limit(0), None, whole=True)

    def search(self, queries: DataFrame, surfaces: DataFrame | None = None, **options) -> DataFrame:
        return search(queries, self.docs(), surfaces, self.postings(), **options)
