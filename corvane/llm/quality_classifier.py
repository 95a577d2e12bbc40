"""Operator 10: quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic regression over built-in features gives each document's own evidence p.  Grouped
sums of p over all documents give, for each host and each path of a host, a Beta posterior of
its share of good documents.  Priors come from the data: the spread between groups beyond what
their sizes explain (method of moments) sets how strongly a group is shrunk, hosts to the
global mean, paths to their host's posterior mean.  A document's odds are its own times the
path's posterior odds over the global odds, as in Bayes' rule with the path as prior.
Host and path come from a URL where there is one (``url_col``).  ``documents`` has none: there
``source`` stands for the host and ``lang`` for the path, so a source's documents are shrunk by
language and there is no evidence of a path.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import checkpointed, fresh, pick
from corvane.llm.features import NAMES, feature_columns
from corvane.session import spread

#: The classifier is fitted on so many labelled rows at most, taken in the order of a hash of their id.
MAX_TRAINING_ROWS = 20_000
#: A posterior table of at most so many paths is broadcast (some 10 MB); a larger one is joined by shuffle.
MAX_BROADCAST_PATHS = 100_000
CLIP = 1e-6


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights (intercept last) of a ridge logistic regression, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) / len(y) + ridge * w * 1e-2
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + np.eye(len(w)) * ridge * 1e-2
        step = np.linalg.solve(h, grad)
        w -= np.clip(step, -20, 20)
        if np.abs(step).max() < 1e-8:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int, id_col: str, text_col: str) -> DataFrame:
    """``(key, quality, <features>)`` of at most ``max_rows`` labelled texts, the same ones on every run.

    Labelled ids are taken in the order of a hash, and of their texts, each counted once, again
    so many at most: an id that many rows share can't exceed the bound.  Of conflicting labels the
    better one counts.
    """
    chosen = (
        pick(labels, id_col, "quality").where(F.col("quality").isNotNull() & F.col(f"`{id_col}`").isNotNull())
        .groupBy(F.col(f"`{id_col}`").alias(id_col)).agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64(F.col(f"`{id_col}`")), F.col(f"`{id_col}`")).limit(max_rows)
    )
    rows = pick(docs, id_col, text_col).join(F.broadcast(chosen), id_col)
    text = F.col(f"`{text_col}`")
    rows = rows.select(F.xxhash64(text).alias("key"), "quality", *[c.alias(n) for n, c in feature_columns(text).items()])
    return rows.groupBy("key").agg(F.max("quality").alias("quality"), *[F.max(n).alias(n) for n in NAMES]).orderBy(F.xxhash64("key"), "key").limit(max_rows)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """The evidence model's weights; without labelled rows of both kinds, none but an even intercept."""
    data = training_rows(docs, labels, max_rows, id_col, text_col).toPandas()
    y = (data["quality"].to_numpy(float) > 0.5).astype(float)
    if len(set(y)) < 2:
        return np.zeros(len(NAMES) + 1)
    x = data[list(NAMES)].to_numpy(float)
    order = np.lexsort((*x.T, y))  # sums don't depend on the order in which rows came
    return fit_logistic(x[order], y[order])


def evidence(text: Column, weights: np.ndarray) -> Column:
    """A document's own log odds of being good."""
    f = feature_columns(text)
    return sum((F.lit(float(w)) * f[n] for n, w in zip(NAMES, weights)), F.lit(float(weights[-1])))


def _probability(log_odds: Column) -> Column:
    return F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), 1 / (1 + F.exp(-log_odds))))


def _concentration(groups: DataFrame, mean: str) -> DataFrame:
    """One row ``k``: the prior's weight in documents, from groups ``(n, s, <mean of the level above>)``."""
    rate = F.col("s") / F.col("n")
    total = groups.agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count("*").alias("g"),
        F.sum(F.col("n") * F.pow(rate - F.col(mean), F.lit(2))).alias("between"),
        (F.sum(F.col("n") * F.col(mean) * (1 - F.col(mean))) / F.sum("n")).alias("noise"),
    )
    spread = (F.col("between") - (F.col("g") - 1) * F.col("noise")) / (F.col("n") - F.col("nn") / F.col("n"))
    k = F.when((F.col("g") > 1) & (spread > 0), F.col("noise") / spread - 1).otherwise(F.lit(1e6))
    return total.select(F.greatest(F.lit(1.0), F.least(F.lit(1e6), k)).alias("k"))


def site_posteriors(scored: DataFrame) -> DataFrame:
    """``(host, path, n, global_mean, host_mean, path_mean)`` from ``(host, path, p)`` of all documents."""
    paths = scored.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum("p").alias("s"))
    paths = checkpointed(paths)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    overall = hosts.agg((F.sum("s") / F.sum("n")).alias("global_mean"))
    hosts = hosts.crossJoin(overall)
    hosts = hosts.crossJoin(_concentration(hosts, "global_mean")).select(
        "host", "global_mean", ((F.col("k") * F.col("global_mean") + F.col("s")) / (F.col("k") + F.col("n"))).alias("host_mean")
    )
    paths = checkpointed(paths.join(hosts, "host"))
    return paths.crossJoin(_concentration(paths, "host_mean")).select(
        "host", "path", "n", "global_mean", "host_mean", ((F.col("k") * F.col("host_mean") + F.col("s")) / (F.col("k") + F.col("n"))).alias("path_mean")
    )


def site_columns(url: Column) -> tuple[Column, Column]:
    """The host and the first part of the path that a URL names; empty where it has none."""
    host = F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))
    return host, F.coalesce(F.regexp_extract(F.try_parse_url(url, F.lit("PATH")), "^/([^/]*)/", 1), F.lit(""))


def _sites(docs: DataFrame, host_col: str, path_col: str, url_col: str | None) -> tuple[Column, Column]:
    if url_col:
        return site_columns(docs[f"`{url_col}`"])
    host, path = (F.coalesce(docs[f"`{c}`"].cast("string"), F.lit("")) for c in (host_col, path_col))
    return host, path


def _with_sites(df: DataFrame, sites: DataFrame, host: str, path: str) -> DataFrame:
    """``df`` with its path's row of ``sites``, which is broadcast only up to a checked size."""
    at = fresh(df, "site_host"), fresh(df, "site_path")
    sites = sites.withColumnsRenamed(dict(zip(("host", "path"), at)))
    if sites.count() <= MAX_BROADCAST_PATHS:
        sites = F.broadcast(sites)
    return df.join(sites, (F.col(f"`{host}`") == F.col(f"`{at[0]}`")) & (F.col(f"`{path}`") == F.col(f"`{at[1]}`")), "left").drop(*at)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", max_rows: int = MAX_TRAINING_ROWS, url_col: str | None = None) -> DataFrame:
    """``(id, host, path, evidence, host_mean, path_mean, score, keep)`` for each row of ``docs``.

    With ``url_col`` host and path are those of a URL.  Null hosts and paths count as the empty
    name.  Null and empty texts have the evidence of an even text.  Repeated rows are kept and
    count as often as they occur; each document is one of those whose sum its path's mean comes
    from.  With no labelled rows everything is kept; an empty table gives an empty result.
    """
    weights = fit(docs, labels, max_rows, id_col, text_col)
    docs = spread(docs)
    host, path = _sites(docs, host_col, path_col, url_col)
    scored = checkpointed(docs.select(docs[f"`{id_col}`"].alias(id_col), host.alias("host"), path.alias("path"), evidence(docs[f"`{text_col}`"], weights).alias("evidence")))
    sites = checkpointed(site_posteriors(scored.withColumn("p", _probability(F.col("evidence")))).drop("n"))
    both = _with_sites(scored, sites, "host", "path")
    return both.select(f"`{id_col}`", "host", "path", "evidence", "host_mean", "path_mean", _score().alias("score"), (_score() >= threshold).alias("keep"))


def _score(log_odds: Column | None = None) -> Column:
    logit = lambda m: F.log(m / (1 - m))
    clip = lambda m: F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), m))
    own = F.col("evidence") if log_odds is None else log_odds
    return 1 / (1 + F.exp(-(own + logit(clip(F.col("path_mean"))) - logit(clip(F.col("global_mean"))))))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", url_col: str | None = None) -> DataFrame:
    """The rows of ``docs`` that :func:`classify` keeps, with all their columns.

    The evidence is computed once for the sites' sums and once more for the filter, which is
    cheaper than to shuffle the texts.  Without labelled rows, and of an empty table, all rows stay.
    """
    weights = fit(docs, labels, MAX_TRAINING_ROWS, id_col, text_col)
    docs = spread(docs)
    host, path = _sites(docs, host_col, path_col, url_col)
    scored = docs.select(host.alias("host"), path.alias("path"), _probability(evidence(docs[f"`{text_col}`"], weights)).alias("p"))
    sites = checkpointed(site_posteriors(scored))
    at = {n: fresh(docs, n) for n in ("host", "path", "shift")}
    logit = lambda c: F.log(F.col(c) / (1 - F.col(c)))
    shifts = sites.select("host", "path", (logit("path_mean") - logit("global_mean")).alias(at["shift"]))
    wide = docs.withColumns({at["host"]: host, at["path"]: path})
    odds = evidence(F.col(f"`{text_col}`"), weights) + F.coalesce(F.col(f"`{at['shift']}`"), F.lit(0.0))
    return _with_sites(wide, shifts, at["host"], at["path"]).where(odds >= float(np.log(threshold / (1 - threshold)))).select(*[f"`{c}`" for c in docs.columns])
