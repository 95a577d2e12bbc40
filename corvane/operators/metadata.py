"""Document metadata, tags and usage (FLT1-FLT9, JN1-JN3, AG1-AG9, TK8-TK9, SNK3-SNK7, RT14)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contains_ci(c: Column, part: str) -> Column:
    """FLT3: substring test that ignores case and takes the part literally."""
    return F.contains(F.lower(c), F.lit(part.lower()))


def filter_documents(docs: DataFrame, tags: DataFrame | None = None, usage: DataFrame | None = None, *, any_tag: list[str] | None = None, category: str | None = None, status: str | None = None, project: str | None = None, created_after: str | None = None, created_before: str | None = None, stale_days: int | None = None, now: Column | None = None, limit: int | None = 50, key: str = "filename") -> DataFrame:
    """FLT1: all given conditions at once, latest update first; conditions that are empty don't count."""
    out = docs
    for name, value in (("category", category), ("status", status), ("project", project)):
        if value:
            out = out.where(F.col(name) == value)
    if created_after:
        out = out.where(F.col("created_date") >= created_after)
    if created_before:
        out = out.where(F.col("created_date") <= created_before)
    if any_tag and tags is not None:
        out = out.join(tags.where(F.lower("tag").isin([t.strip().lower() for t in any_tag])).select(key), key, "left_semi")
    if stale_days and usage is not None:
        out = out.join(_since(usage, stale_days, now).select(key), key, "left_anti")
    out = out.orderBy(F.desc("updated_at"), key)
    return out.limit(limit) if limit else out


def _since(usage: DataFrame, days: int, now: Column | None) -> DataFrame:
    return usage.where(F.col("ts") >= (now if now is not None else F.current_timestamp()) - F.make_interval(days=F.lit(days)))


def title_search(docs: DataFrame, query: str, limit: int = 15, key: str = "filename", title: str = "title", order: str = "updated_at") -> DataFrame:
    """FLT4: documents whose title or name holds one of the query's first five words of over two letters."""
    words = [w for w in query.split() if len(w) > 2][:5]
    if not words:
        return docs.limit(0)
    return docs.where(reduce(lambda a, b: a | b, [contains_ci(F.col(title), w) | contains_ci(F.col(key), w) for w in words])).orderBy(F.desc(order), key).limit(limit)


def with_tags(docs: DataFrame, tags: DataFrame, key: str = "filename") -> DataFrame:
    """RT14: each document with its sorted tags (an empty list for none)."""
    held = tags.groupBy(key).agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    return docs.join(held, key, "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def group_counts(docs: DataFrame, column: str, drop_null: bool = True) -> DataFrame:
    """AG2: rows by value, most first."""
    rows = docs.where(F.col(column).isNotNull()) if drop_null else docs
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def top_tags(tags: DataFrame, limit: int = 10) -> DataFrame:
    """AG3."""
    return tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(limit)


def stale(docs: DataFrame, usage: DataFrame, days: int, now: Column | None = None, key: str = "filename") -> DataFrame:
    """JN3: documents without an event in the last so many days."""
    return docs.join(_since(usage, days, now).select(key), key, "left_anti")


def never_accessed(docs: DataFrame, usage: DataFrame, key: str = "filename") -> DataFrame:
    """JN3/FLT9; events without a document don't matter, unlike in NOT IN."""
    return docs.join(usage.select(key), key, "left_anti")


def most_accessed(docs: DataFrame, usage: DataFrame, limit: int = 10, key: str = "filename", actions: tuple[str, ...] = ("search_hit", "read", "update")) -> DataFrame:
    """JN2/AG4/TK8: events by document, in all and by action, with the latest."""
    joined = usage.join(docs.select(key), key)
    return joined.groupBy(key).agg(F.count("*").alias("total"), *[F.count_if(F.col("action") == a).alias(a) for a in actions], F.max("ts").alias("last_ts")).orderBy(F.desc("total"), key).limit(limit)


def access_history(usage: DataFrame, value, limit: int = 20, key: str = "filename", tie: str = "event_id") -> DataFrame:
    """TK9: the latest events of one document."""
    return usage.where(F.col(key) == value).orderBy(F.desc("ts"), F.desc(tie)).limit(limit)


def daily_trend(usage: DataFrame, days: int, now: Column) -> DataFrame:
    """AG6: events by day over the last so many days."""
    return _since(usage, days, now).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).orderBy("day")


def trend_summary(usage: DataFrame, days: int, now: Column, actions: tuple[str, ...]) -> DataFrame:
    """AG6: one row: total, by action, and the daily average to two places."""
    return _since(usage, days, now).agg(F.count("*").alias("total"), *[F.count_if(F.col("action") == a).alias(a) for a in actions], F.round(F.count("*") / F.lit(days), 2).alias("per_day"))


def usage_by_action(usage: DataFrame, key: str = "filename") -> DataFrame:
    """AG6: events by action, and how many documents they touch."""
    return usage.groupBy("action").agg(F.count("*").alias("n"), F.count_distinct(F.col(key)).alias("documents"))


def distinct_values(docs: DataFrame, column: str, limit: int = 50) -> DataFrame:
    """AG9: a column's values in order, the first so many."""
    return docs.select(column).distinct().orderBy(column).limit(limit)


def breakdown(docs: DataFrame, by: str, of: str, name: str) -> DataFrame:
    """AG8: rows of each value of ``by``, and how many values of ``of`` they have."""
    return docs.groupBy(by).agg(F.count("*").alias("n"), F.count_distinct(F.col(of)).alias(name))


def json_counts(rows: DataFrame, column: str, path: str, kind: str, name: str) -> DataFrame:
    """FLT8/AG8: rows by the value at a path of a JSON column; those without it don't count."""
    value = F.get_json_object(column, path).cast(kind)
    return rows.where(value.isNotNull()).groupBy(value.alias(name)).agg(F.count("*").alias("n"))


def upsert(old: DataFrame, new: DataFrame, key: str | list[str] = "filename") -> DataFrame:
    """SNK1/SNK3: rows of ``new`` replace those of the same key; of rows in ``new`` that share a key one stays."""
    keys = [key] if isinstance(key, str) else key
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.dropDuplicates(keys), allowMissingColumns=True)


def normalised_tags(pairs: DataFrame, key: str = "filename", tag: str = "tag") -> DataFrame:
    """SNK5: tags trimmed, in small letters, without blanks and repeats."""
    t = F.lower(F.trim(F.col(tag)))
    return pairs.select(key, t.alias("tag")).where(F.length("tag") > 0).distinct()


def replace_tags(tags: DataFrame, new: DataFrame, key: str = "filename") -> DataFrame:
    """SNK5 on re-indexing: the documents of ``new`` have just its tags (a null tag: none)."""
    return tags.join(new.select(key).distinct(), key, "left_anti").unionByName(normalised_tags(new, key))


def log_usage(usage: DataFrame, events: DataFrame, docs: DataFrame, key: str = "filename") -> DataFrame:
    """SNK6: the log with the events of documents that exist."""
    return usage.unionByName(events.join(docs.select(key), key, "left_semi"), allowMissingColumns=True)


def cross_references(refs: DataFrame, kind: str = "wiki_link", key: str = "filename") -> DataFrame:
    """SNK6: ``(key, ref_type, ref_target)``, each once and none to nothing."""
    return refs.where(F.length(F.trim("ref_target")) > 0).select(key, F.lit(kind).alias("ref_type"), "ref_target").distinct()


def add_cross_refs(held: DataFrame, refs: DataFrame, docs: DataFrame, kind: str = "references", key: str = "filename") -> DataFrame:
    """SNK6: the table with references of documents that exist; those it has already stay once."""
    return held.unionByName(cross_references(refs, kind, key).join(docs.select(key), key, "left_semi")).distinct()


def remove_documents(names: DataFrame, docs: DataFrame, *children: DataFrame, key: str = "filename") -> tuple[DataFrame, ...]:
    """SNK2/SNK7: documents and their rows in all child tables (tags without documents go with them)."""
    gone = names.select(key).distinct()
    return tuple(t.join(gone, key, "left_anti") for t in (docs, *children))


def remove_by_prefix(docs: DataFrame, prefix: str, key: str = "doc_id") -> DataFrame:
    """SNK2/FLT5: without the keys that begin with a prefix, taken literally."""
    return docs.where(~F.coalesce(F.startswith(F.col(key), F.lit(prefix)), F.lit(False)))


def extract_metadata(files: DataFrame, front: str = "front", key: str = "filename") -> DataFrame:
    """SNK4: known front-matter keys (a string map) as columns with their fallbacks, the rest as ``meta``."""
    g = lambda *names: F.coalesce(*[F.col(front)[n] for n in names])
    known = ("title", "category", "type", "status", "project", "created_date", "date", "updated_date", "modified", "tags")
    rest = F.map_filter(front, lambda k, v: ~k.isin(*known))
    return files.select(key, F.coalesce(g("title"), F.col("title")).alias("title"), g("category", "type").alias("category"), F.coalesce(g("status"), F.lit("active")).alias("status"), g("project").alias("project"), g("created_date", "date").alias("created_date"), g("updated_date", "modified").alias("updated_date"), rest.alias("meta"))


def latest(docs: DataFrame, limit: int = 10, order: str = "updated_at", key: str = "filename") -> DataFrame:
    """TK8: the documents updated last."""
    return docs.orderBy(F.desc(order), key).limit(limit)


def first_of(df: DataFrame, by: list[str], *order: Column | str) -> DataFrame:
    """AG11: the first row of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")
