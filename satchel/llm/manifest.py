"""Merkle manifest of a dataset: a slot pivot hashes each parent's children; paths of siblings go back down to the leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ranking import ranked
from ..storage import dropped, stored

#: Children of a node; the last run of a level may have fewer.
FANOUT = 3
_PATH = "array<struct<before:string,after:string>>"


def hashed(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts in a row; nulls add nothing."""
    return F.sha2(F.concat(*[F.coalesce(p, F.lit("")) for p in parts]), 256)


def field(value: Column) -> Column:
    """`-` if null, else the number of UTF-8 bytes, a colon, and the value: no two rows of fields read alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return hashed(*map(field, values))


def tree(nodes: DataFrame) -> list[DataFrame]:
    """nodes(grp, pos, cnt, node struct with `hash`) -> one table per level above: grp, pos, cnt, hash, k0, k1, k2 (the children's structs).

    Conditional aggregates spread the children of a parent over FANOUT columns by pos % FANOUT; the columns in a row are hashed. Groups of one node are done.
    A parent's key is its group and place, so a group of any size spreads over all tasks.
    """
    most = nodes.agg(F.max("cnt")).first()[0] or 1
    levels = []
    while most > 1:
        slot = F.col("pos") % FANOUT
        up = nodes.where("cnt > 1").groupBy("grp", F.floor(F.col("pos") / FANOUT).alias("up"))
        kids = [f"k{s}" for s in range(FANOUT)]
        up = up.agg(*[F.max(F.when(slot == s, F.col("node"))).alias(k) for s, k in enumerate(kids)], F.max("cnt").alias("below"))
        up = up.select("grp", F.col("up").alias("pos"), F.expr(f"(below + {FANOUT - 1}) div {FANOUT}").alias("cnt"), hashed(*[F.col(f"{k}.hash") for k in kids]).alias("hash"), *kids)
        levels.append(stored(up, f"level{len(levels) + 1}"))
        nodes = levels[-1].select("grp", "pos", "cnt", F.struct("hash").alias("node"))
        most = -(-most // FANOUT)
    return levels


def tops(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """grp, level, hash of each group's last node."""
    out = leaves.where("cnt = 1").select("grp", F.lit(0).alias("level"), F.col("node.hash").alias("hash"))
    for k, level in enumerate(levels, 1):
        out = out.unionByName(level.where("cnt = 1").select("grp", F.lit(k).alias("level"), "hash"))
    return out


def paths(leaves: DataFrame, levels: list[DataFrame], starts: DataFrame) -> DataFrame:
    """grp, node, path and starts' other columns for each leaf. starts(grp, level, path, ...): the paths above each group's last node.

    From the top down each parent hands its path to its children, with their siblings put before it: all slots but their own.
    """
    more = [c for c in starts.columns if c not in ("grp", "level", "path")]
    at = lambda k: starts.where(F.col("level") == k).select("grp", F.lit(0).cast("long").alias("pos"), "path", *more)
    now = at(len(levels))
    for k in range(len(levels), 0, -1):
        both = levels[k - 1].select("grp", "pos", *[f"k{s}" for s in range(FANOUT)]).join(now, ["grp", "pos"])
        kid = [F.col(f"k{s}") for s in range(FANOUT)]
        beside = lambda s: F.struct(*[F.concat(F.lit(""), *[F.coalesce(x["hash"], F.lit("")) for x in part]).alias(n) for n, part in (("before", kid[:s]), ("after", kid[s + 1 :]))])
        slots = F.array(*[F.when(x.isNotNull(), F.struct(F.lit(s).alias("slot"), x.alias("node"), beside(s).alias("beside"))) for s, x in enumerate(kid)])
        down = both.select("grp", "pos", "path", *more, F.explode(F.filter(slots, lambda x: x.isNotNull())).alias("kid"))
        down = down.select("grp", (F.col("pos") * FANOUT + F.col("kid.slot")).alias("pos"), F.concat(F.array("kid.beside"), "path").alias("path"), *more, F.col("kid.node").alias("node"))
        now = down.drop("node").unionByName(at(k - 1)) if k > 1 else down.drop("pos")
    single = leaves.where("cnt = 1").select("grp", "node").join(starts.where("level = 0"), "grp").select("grp", "path", *more, "node")
    return now.unionByName(single) if levels else single


def proof(path: Column) -> Column:
    """The hash of all siblings on a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, p: F.sha2(F.concat(p["before"], h, p["after"]), 256))


def manifest(docs: DataFrame, leaf: Column, id_col: str = "doc_id", group_col: str = "source", *, other: Column | None = None) -> DataFrame:
    """One row per input row: id_col, group_col, leaf, other, subroot, root, path (array of before, after: the siblings' hashes, level by level).

    leaf: the hash of a row (see leaf_hash); other: a second hash to carry along, of a row as it should not be, say. Per group the leaves
    ascend by id; every FANOUT consecutive nodes become their hash until one is left, the subroot; the subroots, ordered by group, likewise give the root.

    Texts are read and hashed once, and only hashes are dealt out. Levels are tables, each a third of the one below; a path goes down level by level,
    so all joins are on unique keys and together have half as many rows as there are leaves.

    Defined cases: null fields are marked apart from empty ones; null ids come first; rows of the same id are ordered by their leaves, equal ones
    give equal leaves but each its own place; a null group is a group, the first; an empty table gives no rows and no root; other columns, whatever their names, are left
    aside unless a leaf takes them in; a very long text is hashed in the task that reads it.
    """
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))  # null sorts first, and joins
    rows = docs.select(group.alias("grp"), F.col(id_col).alias("id"), leaf.alias("leaf"), (F.lit(None).cast("string") if other is None else other).alias("other"), F.monotonically_increasing_id().alias("tie"))
    rows = stored(rows, "leaves")
    leaves = ranked(rows, "grp", "id", "leaf", "tie").select("grp", "pos", "cnt", F.struct(F.col("leaf").alias("hash"), "id", "other").alias("node"))
    leaves = stored(leaves, "ranked")
    levels = tree(leaves)
    subroots = stored(tops(leaves, levels), "subroots")
    above = ranked(subroots.withColumn("all", F.lit("")), "all", "grp").select(F.col("all").alias("grp"), "pos", "cnt", F.struct("hash", F.col("grp").alias("own"), "level").alias("node"))
    above = stored(above, "groups")
    upper = tree(above)
    root = tops(above, upper).select("grp", "level", F.array().cast(_PATH).alias("path"), F.col("hash").alias("root"))
    starts = paths(above, upper, root).select(F.col("node.own").alias("grp"), "node.level", "path", F.col("node.hash").alias("subroot"), "root")
    starts = stored(starts, "starts")
    out = paths(leaves, levels, starts)
    dropped(rows, subroots, above, *upper)
    name = F.when(F.col("grp") != "", F.substring("grp", 2, 2**31 - 1))
    return out.select(F.col("node.id").alias(id_col), name.alias(group_col), F.col("node.hash").alias("leaf"), F.col("node.other").alias("other"), "subroot", "root", "path")


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.replace("text", F.lit("\n"), F.lit(""))
    changed = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains("text", F.lit("\n"))
    rows = manifest(docs, leaf_hash(*[F.col(c) for c in columns]), other=F.when(changed, leaf_hash(*[F.col(c) for c in columns[:-1]], tampered)))
    rows = rows.withColumn("folded_root", folded(F.coalesce("other", "leaf"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


OP13_SQL = r"""
WITH RECURSIVE parts AS (
  SELECT row_number() OVER () AS row, doc_id, source, text,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295::BIGINT) AS crc
  FROM documents
), hashed AS (
  SELECT *, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other FROM parts
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS cnt
  FROM (SELECT row, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS alt FROM hashed)
), low(k, source, pos, cnt, h) AS (
  SELECT 0, source, pos, cnt, leaf FROM leaves
  UNION ALL SELECT k + 1, source, pos // 3, (max(cnt) + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM low WHERE cnt > 1 GROUP BY k, source, pos // 3
), subs AS (
  SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS cnt FROM low WHERE cnt = 1
), high(k, pos, cnt, h) AS (
  SELECT 0, pos, cnt, subroot FROM subs
  UNION ALL SELECT k + 1, pos // 3, (max(cnt) + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM high WHERE cnt > 1 GROUP BY k, pos // 3
), steps AS (
  SELECT d.row, n.k, string_agg(n.h, '' ORDER BY n.pos) FILTER (n.pos < d.pos // (3 ** n.k)::BIGINT) AS before, string_agg(n.h, '' ORDER BY n.pos) FILTER (n.pos > d.pos // (3 ** n.k)::BIGINT) AS after
  FROM leaves d JOIN low n ON n.source IS NOT DISTINCT FROM d.source AND n.cnt > 1 AND n.pos // 3 = d.pos // (3 ** (n.k + 1))::BIGINT GROUP BY d.row, d.pos, n.k
  UNION ALL
  SELECT d.row, 1000 + n.k, string_agg(n.h, '' ORDER BY n.pos) FILTER (n.pos < s.pos // (3 ** n.k)::BIGINT), string_agg(n.h, '' ORDER BY n.pos) FILTER (n.pos > s.pos // (3 ** n.k)::BIGINT)
  FROM leaves d JOIN subs s ON s.source IS NOT DISTINCT FROM d.source JOIN high n ON n.cnt > 1 AND n.pos // 3 = s.pos // (3 ** (n.k + 1))::BIGINT GROUP BY d.row, s.pos, n.k
), numbered AS (
  SELECT row, coalesce(before, '') AS before, coalesce(after, '') AS after, row_number() OVER (PARTITION BY row ORDER BY k) - 1 AS i FROM steps
), proofs AS (SELECT row, sha256(string_agg(before || after, '' ORDER BY i)) AS proof, count(*) AS n FROM numbered GROUP BY row),
fold(row, i, h) AS (
  SELECT row, 0, alt FROM leaves
  UNION ALL SELECT f.row, f.i + 1, sha256(s.before || f.h || s.after) FROM fold f JOIN numbered s ON s.row = f.row AND s.i = f.i
)
SELECT d.doc_id, d.leaf, s.subroot, r.h AS root, coalesce(p.proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM leaves d JOIN subs s ON s.source IS NOT DISTINCT FROM d.source JOIN high r ON r.cnt = 1 LEFT JOIN proofs p ON p.row = d.row JOIN fold f ON f.row = d.row AND f.i = coalesce(p.n, 0)
"""
