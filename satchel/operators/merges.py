"""Keyed merges: (current, change, now) -> new table, a full outer join on the key with a rule per column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import checked, command_key
from ..functions.texts import fill_empty
from ..functions.urls import host_of, url_hash


def given(new: Column, old: Column) -> Column:
    """The new value if it isn't empty."""
    return F.coalesce(F.nullif(new, F.lit("")), old)


def merge_saves(links: DataFrame, saves: DataFrame, now: int) -> DataFrame:
    """links joined with saves(url, title, description, body_text, keywords, note, created_at) on the URL's hash.

    New: inserted as pending, id null until written. Live duplicate: unchanged, but a client body over another one
    fills in, and a failed link is done. Deleted: comes back as pending with the new note. outcome says which. Of several saves
    of a URL the first (by created_at, then note) counts.
    """
    w = Window.partitionBy("h").orderBy("created_at", "note")
    s = saves.withColumn("h", url_hash(F.col("url"))).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    s = s.select("h", F.struct("*").alias("s"))
    c = links.withColumn("h", url_hash(F.col("url"))).select("h", F.struct("*").alias("c"))
    j = c.join(s, "h", "full_outer")
    old, new = (lambda n: F.col(f"c.{n}")), (lambda n: F.coalesce(F.col(f"s.{n}"), F.lit("")))
    body = F.when(new("body_text") != "", "client").otherwise("")
    fresh = F.col("c.url").isNull()
    back = ~fresh & F.col("s.url").isNotNull() & old("deleted_at").isNotNull()
    fill = ~fresh & F.col("s.url").isNotNull() & old("deleted_at").isNull() & (new("body_text") != "") & (old("body_source") != "client")
    change = back | fill
    known = {"id", "url", "title", "description", "body_text", "keywords", "note", "body_source", "status", "created_at", "deleted_at"}
    text = lambda n: F.when(fresh, new(n)).when(change, given(new(n), old(n))).otherwise(old(n)).alias(n)
    status = F.when(fresh | back, "pending").when(fill & (old("status") == "failed"), "done").otherwise(old("status"))
    return j.select(
        old("id").alias("id"),
        F.coalesce(old("url"), F.col("s.url")).alias("url"),
        *[text(n) for n in ("title", "description", "body_text", "keywords")],
        F.when(fresh | back, new("note")).otherwise(old("note")).alias("note"),
        F.when(fresh | back, body).when(fill, "client").otherwise(old("body_source")).alias("body_source"),
        status.alias("status"),
        F.coalesce(old("created_at"), F.nullif(F.col("s.created_at"), F.lit(0)), F.lit(now)).alias("created_at"),
        F.when(~back, old("deleted_at")).alias("deleted_at"),
        *[old(n).alias(n) for n in links.columns if n not in known],
        F.when(fresh, "saved").when(back, "revived").when(fill, "filled").when(F.col("s.url").isNotNull(), "duplicate").otherwise("kept").alias("outcome"),
    )


def revived_tags(link_tags: DataFrame, merged: DataFrame) -> DataFrame:
    """link_tags without those of links that merge_saves brought back: a revived link starts without tags."""
    back = merged.where("outcome = 'revived'").select(F.col("id").alias("link_id"))
    return link_tags.join(back, "link_id", "left_anti")


def merge_extractions(links: DataFrame, fields: DataFrame) -> DataFrame:
    """fields(id, title, description, body_text, keywords): what a client captured stays; empty bodies and keywords erase nothing."""
    f = fields.select("id", F.struct("*").alias("f"))
    j = links.join(f, "id", "left")
    open_ = F.col("f").isNotNull() & F.col("deleted_at").isNull()
    take = open_ & (F.col("body_source") != "client")
    return j.select(
        *[c for c in links.columns if c not in {"title", "description", "body_text", "keywords", "body_source", "status"}],
        *[F.when(take, F.col(f"f.{n}")).otherwise(F.col(n)).alias(n) for n in ("title", "description")],
        *[F.when(take, given(F.col(f"f.{n}"), F.col(n))).otherwise(F.col(n)).alias(n) for n in ("body_text", "keywords")],
        F.when(take & (F.col("f.body_text") != ""), "server").otherwise(F.col("body_source")).alias("body_source"),
        F.when(open_, "done").otherwise(F.col("status")).alias("status"),
    )


def apply_tags(link_tags: DataFrame, scored: DataFrame) -> DataFrame:
    """scored(link_id, tag_id, confidence): replaces the scored links' rules rows; manual and other rows stay and win."""
    touched = scored.select("link_id").distinct().withColumn("touched", F.lit(True))
    kept = link_tags.join(touched, "link_id", "left").where("touched IS NULL OR source <> 'rules'").drop("touched")
    new = scored.join(kept.select("link_id", "tag_id"), ["link_id", "tag_id"], "left_anti")
    return kept.select("link_id", "tag_id", "source", "confidence").unionByName(new.select("link_id", "tag_id", F.lit("rules").alias("source"), "confidence"))


def update_terms(link_terms: DataFrame, touched: DataFrame, terms: DataFrame) -> DataFrame:
    """Retract the touched links' terms, add the new ones once each. Frequencies are derived, so they can't drift."""
    return link_terms.join(touched, "link_id", "left_anti").unionByName(terms.select("link_id", "term").distinct())


def tag_diff(current: DataFrame, wanted: DataFrame) -> DataFrame:
    key = ["link_id", "name"]
    added = wanted.select(*key).distinct().join(current, key, "left_anti").withColumn("action", F.lit("added"))
    return added.unionByName(current.select(*key).join(wanted, key, "left_anti").withColumn("action", F.lit("removed")))


def replace_tags(current: DataFrame, wanted: DataFrame, tags: DataFrame, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """current, wanted(link_id, name) -> (new attachments of the links in wanted, feedback rows, unknown names)."""
    known = wanted.join(tags.select("name"), "name", "left_semi")
    unknown = wanted.join(tags.select("name"), "name", "left_anti")
    mine = current.join(wanted.select("link_id").distinct(), "link_id", "left_semi")
    return known.select("link_id", "name").distinct(), tag_diff(mine, known).withColumn("created_at", F.lit(now)), unknown


def soft_delete(links: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    gone = ids.select("id").distinct().withColumn("gone", F.lit(True))
    return links.join(gone, "id", "left").withColumn("deleted_at", F.when(F.col("gone") & F.col("deleted_at").isNull(), F.lit(now)).otherwise(F.col("deleted_at")).cast("long")).drop("gone")


def retract(ids: DataFrame, link_terms: DataFrame, search_docs: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What goes with the links of ids when they are deleted: their terms, their search documents, and jobs that haven't begun."""
    gone = ids.select(F.col("id").alias("link_id")).distinct()
    waiting = jobs.where("status = 'pending'").join(gone, "link_id", "left_semi").select("id")
    return link_terms.join(gone, "link_id", "left_anti"), search_docs.join(gone.withColumnRenamed("link_id", "doc_id"), "doc_id", "left_anti"), jobs.join(waiting, "id", "left_anti")


def mark_opened(links: DataFrame, opens: DataFrame) -> DataFrame:
    last = opens.groupBy("id").agg(F.max("at").alias("opened"))
    return links.join(last, "id", "left").withColumn("opened_at", F.coalesce("opened", "opened_at")).drop("opened")


def duplicate_tags(changes: DataFrame) -> DataFrame:
    """name (lower case), n: names that come more than once among the changes, whatever their case; such a change is to be refused."""
    return changes.groupBy(F.lower("name").alias("name")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def upsert_tags(tags: DataFrame, changes: DataFrame) -> DataFrame:
    """changes(name, facet?): unique names, whatever their case; missing fields stay. New tags get the next ids, in order of their names."""
    c = changes.groupBy(F.lower("name").alias("k")).agg(F.min("name").alias("new_name"), F.max("facet").alias("new_facet"))
    j = tags.withColumn("k", F.lower("name")).join(c, "k", "full_outer")
    new = j.where("id IS NULL").select("k", F.row_number().over(Window.orderBy("k")).alias("__nth"))  # a table of tags, written by hand
    top = tags.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__top"))
    j = j.join(new, "k", "left").crossJoin(top)  # one row
    return j.select(F.coalesce(F.col("id"), F.col("__top") + F.col("__nth")).alias("id"), F.coalesce("name", "new_name").alias("name"), F.coalesce("new_facet", "facet", F.lit("neutral")).alias("facet"))


def delete_tags(tags: DataFrame, link_tags: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = ids.select(F.col("id").alias("gone"))
    return tags.join(gone, tags["id"] == gone["gone"], "left_anti"), link_tags.join(gone, link_tags["tag_id"] == gone["gone"], "left_anti")


def set_summaries(links: DataFrame, summaries: DataFrame) -> DataFrame:
    """An empty summary is a value."""
    s = summaries.select("id", F.col("summary").alias("new_summary"), F.lit(True).alias("set"))
    return links.join(s, "id", "left").withColumn("summary", F.when(F.col("set"), F.col("new_summary")).otherwise(F.col("summary"))).drop("new_summary", "set")


def refill(golden: DataFrame, fresh: DataFrame, key: str, fields: list[str]) -> DataFrame:
    f = fresh.select(key, *[F.col(c).alias(f"__{c}") for c in fields])
    j = golden.join(f, key, "left")
    return j.withColumns({c: F.coalesce(fill_empty(F.col(c), F.col(f"__{c}")), F.col(c)) for c in fields}).drop(*[f"__{c}" for c in fields])


def parse_commands(rows: DataFrame) -> DataFrame:
    """rows(id, action, value, note, box), all text -> link_id, action, value, key of the checked and well-formed ones."""
    id_, action, value = F.coalesce(F.trim("id").try_cast("long"), F.lit(0)), F.trim("action"), F.coalesce(F.trim("value"), F.lit(""))
    fits = (action.isin("note", "tags", "delete", "retry") & (id_ > 0)) | ((action == "save") & (value != ""))
    c = rows.where(checked(F.col("box")) & fits).select(F.when(action == "save", 0).otherwise(id_).cast("long").alias("link_id"), action.alias("action"), value.alias("value"))
    return c.withColumn("key", command_key(F.col("link_id"), F.col("action"), F.col("value"))).distinct()


def apply_commands(rows: DataFrame, ledger: DataFrame, links: DataFrame, now: int, attached: DataFrame | None = None, tags: DataFrame | None = None) -> dict[str, DataFrame]:
    """Commands not applied before: links with notes, deletions, retries and saves merged in, wanted tags, the new ledger (keys whose row is still there) and the log with previous notes.

    Given attached(link_id, name) and the table of tags, the wanted ones are set too: attached, feedback and unknown names come back as well.
    """
    all_ = parse_commands(rows)
    todo = all_.join(ledger, "key", "left_anti")
    of = lambda a: todo.where(F.col("action") == a)
    notes = of("note").groupBy(F.col("link_id").alias("id")).agg(F.max("value").alias("new_note"))
    out = soft_delete(links, of("delete").select(F.col("link_id").alias("id")), now).join(notes, "id", "left").withColumn("note", F.coalesce("new_note", "note")).drop("new_note")
    asked = of("retry").select(F.col("link_id").alias("id")).distinct().withColumn("ask", F.lit(True))
    out = out.join(asked, "id", "left").withColumn("status", F.when(F.col("ask") & (F.col("status") == "failed") & F.col("deleted_at").isNull(), "pending").otherwise(F.col("status"))).drop("ask")
    saves = of("save").select(F.col("value").alias("url"), *[F.lit("").alias(n) for n in ("title", "description", "body_text", "keywords", "note")], F.lit(0).cast("long").alias("created_at"))
    out = merge_saves(out, saves, now).drop("outcome").select(*links.columns)
    wanted = of("tags").select("link_id", F.explode(F.filter(F.transform(F.split("value", ","), lambda s: F.trim(s)), lambda t: t != "")).alias("name"))
    log = todo.join(links.select(F.col("id").alias("link_id"), F.col("note").alias("previous")), "link_id", "left")
    kept = ledger.unionByName(todo.select("key")).distinct().join(all_.select("key"), "key", "left_semi")
    done = {"links": out, "wanted": wanted, "ledger": kept, "log": log}
    if attached is not None and tags is not None:
        own, feedback, unknown = replace_tags(attached, wanted, tags, now)
        rest = attached.join(of("tags").select("link_id").distinct(), "link_id", "left_anti")
        done |= {"attached": rest.unionByName(own), "feedback": feedback, "unknown": unknown}
    return done


def retry_failed(links: DataFrame, jobs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links with the failed ones of ids back to pending and their error cleared, jobs without the failed ones of these links, ids that aren't failed and live)."""
    failed = links.where("status = 'failed' AND deleted_at IS NULL").select("id")
    hit = ids.select("id").distinct().join(failed, "id", "left_semi")
    error = F.col("error") if "error" in links.columns else F.lit(None).cast("string")
    out = links.join(hit.withColumn("hit", F.lit(True)), "id", "left").withColumns({"status": F.when(F.col("hit"), "pending").otherwise(F.col("status")), "error": F.when(F.col("hit"), None).otherwise(error)}).drop("hit")
    old = jobs.where("status = 'failed'").join(hit.withColumnRenamed("id", "link_id"), "link_id", "left_semi").select("id")
    return out, jobs.join(old, "id", "left_anti"), ids.select("id").distinct().join(failed, "id", "left_anti")


def settle_failures(links: DataFrame, jobs: DataFrame) -> DataFrame:
    """A job's final failure marks its link failed, or done if the client captured it, and the link keeps the cause; tag and thumb jobs don't count. jobs(id, link_id, kind, status, error)."""
    last = jobs.where("kind NOT IN ('tag', 'thumb')").groupBy("link_id").agg(F.max_by(F.struct("status", "error"), "id").alias("job"))
    error = F.col("error") if "error" in links.columns else F.lit(None).cast("string")
    j = links.withColumn("error", error).join(last, links["id"] == last["link_id"], "left")
    hit = F.col("job.status") == "failed"
    status = F.when(hit & (F.col("body_source") == "client"), "done").when(hit, "failed").otherwise(F.col("status"))
    return j.withColumns({"status": status, "error": F.when(hit, F.col("job.error")).otherwise(F.col("error"))}).drop("link_id", "job")


def dedupe_new(incoming: DataFrame, links: DataFrame) -> DataFrame:
    return incoming.withColumn("url_hash", url_hash(F.col("url"))).join(links.select(url_hash(F.col("url")).alias("url_hash")), "url_hash", "left_anti")


def dictionary_drift(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b(name, facet, aliases) -> name, facet, other, missing (aliases that only a has), extra (only b): where two dictionaries differ; the order of aliases doesn't matter."""
    none = F.array().cast("array<string>")
    x = b.select("name", F.col("facet").alias("other"), F.coalesce("aliases", none).alias("theirs"))
    j = a.select("name", "facet", F.coalesce("aliases", none).alias("ours")).join(x, "name", "full_outer")
    only = lambda p, q: F.array_sort(F.array_except(F.coalesce(p, none), F.coalesce(q, none)))
    j = j.select("name", "facet", "other", only("ours", "theirs").alias("missing"), only("theirs", "ours").alias("extra"))
    return j.where("NOT (facet <=> other) OR size(missing) > 0 OR size(extra) > 0")


def record_recognition(log: DataFrame, shown: DataFrame) -> DataFrame:
    """shown(link_id, rung, shown_at): new rows of the log, untapped, with the ids that follow its last one, in order of time, then link."""
    top = log.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__top"))
    per = Window.partitionBy("shown_at").orderBy("link_id", "rung")
    before = shown.groupBy("shown_at").agg(F.count(F.lit(1)).alias("__n"))  # a row per moment: what is ordered in one task
    before = before.select("shown_at", (F.sum("__n").over(Window.orderBy("shown_at")) - F.col("__n")).alias("__before"))
    new = shown.withColumn("__nth", F.row_number().over(per)).join(before, "shown_at").crossJoin(top)  # one row
    return log.unionByName(new.select((F.col("__top") + F.col("__before") + F.col("__nth")).alias("id"), "link_id", "rung", "shown_at", F.lit(None).cast("long").alias("tapped_at")))


def merge_poll(current: DataFrame, page: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Page rows overwrite or come in; deleted ones never come back."""
    p = page.select("id", F.struct("*").alias("p"))
    j = current.select("id", F.struct("*").alias("c")).join(p, "id", "full_outer").select("id", F.coalesce("p", "c").alias("r"))
    return j.select("r.*").join(tombstones.select("id"), "id", "left_anti")


def board(links: DataFrame, card: DataFrame, *, filtered: bool) -> DataFrame:
    return links if filtered else links.join(card.select("id"), "id", "left_anti")


def ledger_keep(ledger: DataFrame, seen: DataFrame) -> DataFrame:
    return ledger.join(seen.select("key").distinct(), "key", "left_semi")


def union_sets(*sets: DataFrame, key: str = "url") -> DataFrame:
    """One table, the first set that has a key wins."""
    from functools import reduce

    tagged = [s.withColumn("__set", F.lit(i)) for i, s in enumerate(sets)]
    u = reduce(lambda a, b: a.unionByName(b), tagged)
    return u.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy("__set"))).where("__rn = 1").drop("__rn", "__set")


def split_leak(sets: DataFrame, key: str = "url", of: str = "set") -> DataFrame:
    return sets.groupBy(key).agg(F.countDistinct(of).alias("sets")).where("sets > 1")


def export_links(links: DataFrame, link_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """The flat table: id, saved, url, domain, title, description, tags, note, status of live links, formulas escaped."""
    from ..functions.texts import escape_formula
    from .tagging import attach_tags, live

    t = attach_tags(live(links), link_tags, tags)
    names = F.coalesce(F.array_join(F.transform("tags", lambda x: x["name"]), ", "), F.lit(""))
    return t.select("id", F.col("created_at").alias("saved"), "url", host_of(F.col("url")).alias("domain"), escape_formula(F.col("title")).alias("title"), escape_formula(F.col("description")).alias("description"), names.alias("tags"), "note", "status")


def label_candidates(links: DataFrame, link_tags: DataFrame, tags: DataFrame, min_body: int = 200) -> DataFrame:
    from .tagging import attach_tags, live

    t = attach_tags(live(links).where((F.col("body_source") == "client") & (F.length("body_text") >= min_body)), link_tags, tags)
    return t.select("url", F.struct("title", "description", "body_text", "keywords", "body_source").alias("snapshot"), F.array().cast("array<string>").alias("expected_tags"), F.coalesce(F.transform("tags", lambda x: x["name"]), F.array().cast("array<string>")).alias("current_tags"))
