"""Operator 5: quality rules with risk-controlled thresholds.

A rule rejects a document whose feature exceeds a cutoff.  Per stratum (language) and rule,
cutoffs of a fixed grid are tested from the most lenient to the strictest on all labelled
documents: with k of n good ones beyond the cutoff, the hypothesis "more than ``alpha`` of good
documents are rejected" has the exact binomial p-value P(Bin(n, alpha) <= k).  Testing stops at
the first cutoff that isn't significant (fixed-sequence testing), so within a rule no further
correction is needed; over strata and rules the level is divided (Bonferroni).  ``alpha`` is
shared by the rules, so that all of them together reject at most ``risk`` of a stratum's good
documents, with probability 1 - ``delta`` for all strata at once.  Where labelled documents are
too few to show this, the rule rejects nothing.

The bound needs independent trials, and copies aren't: however often a text occurs in a stratum,
under one id or many, it is one trial.  A text counts as good if any of its rows is labelled good.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import checkpointed, pick
from corvane.llm.features import NAMES, feature_columns
from corvane.session import spread

#: Cutoffs that are tried, the same for each rule.
GRID = tuple(round(k / 200, 3) for k in range(2, 201))
RISK, DELTA = 0.04, 0.05
MAX_BROADCAST_STRATA = 20_000


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), summed in logarithms; 1 for n = 0."""
    if n <= 0 or k >= n:
        return 1.0
    i = np.arange(1, k + 1, dtype=float)
    # each term's logarithm from the one before
    logs = n * math.log1p(-p) + np.r_[0.0, np.cumsum(np.log((n - i + 1) / i) + math.log(p) - math.log1p(-p))]
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


def upper_bound(k: int, n: int, delta: float) -> float:
    """The exact (Clopper-Pearson) upper bound of a rate of which k of n were seen."""
    if n <= 0 or k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if binomial_cdf(k, n, mid) > delta else (low, mid)
    return high


def thresholds(features: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, id_col: str = "doc_id") -> DataFrame:
    """``(stratum, rule, cutoff, n_good, n_rejected, bound)`` for each stratum and rule with good labelled documents.

    ``features`` has ``(id, stratum, copy, <rules>)`` of all documents; rows of a stratum with equal
    ``copy`` have the same text and are one trial.  A null cutoff rejects nothing.
    """
    good = pick(labels, id_col, "quality").where("quality = 1").select(F.col(f"`{id_col}`")).distinct()
    rows = features.join(good, id_col).select("stratum", "copy", *NAMES).distinct()
    # For each rule, the number of cutoffs that the value exceeds: it is rejected by just the first so many.
    beyond = lambda n: F.least(F.lit(len(GRID)), F.greatest(F.lit(0), F.ceil(F.round(F.col(n) * 200, 9)) - 2)).cast("int")
    counts = (
        rows.select("stratum", F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), beyond(n).alias("beyond")) for n in NAMES])).alias("x"))
        .groupBy("stratum", "x.rule", "x.beyond").agg(F.count("*").alias("n"))
    )
    families = rows.agg((F.count_distinct("stratum") * len(NAMES)).alias("families"))
    counts = counts.crossJoin(F.broadcast(families))
    alpha = risk / len(NAMES)

    def choose(groups: pd.DataFrame) -> pd.DataFrame:
        n = int(groups["n"].sum())
        level = delta / int(groups["families"].iloc[0])
        at = np.zeros(len(GRID) + 1, dtype=np.int64)
        np.add.at(at, groups["beyond"].to_numpy(), groups["n"].to_numpy())
        rejected = at[::-1].cumsum()[::-1][1:]  # by the cutoff of each place of the grid
        best = None
        for g in range(len(GRID) - 1, -1, -1):
            if binomial_cdf(int(rejected[g]), n, alpha) > level:
                break
            best = g
        k = 0 if best is None else int(rejected[best])
        return pd.DataFrame({"stratum": [groups["stratum"].iloc[0]], "rule": [groups["rule"].iloc[0]], "cutoff": [None if best is None else GRID[best]], "n_good": [n], "n_rejected": [k], "bound": [upper_bound(k, n, level)]})

    return counts.groupBy("stratum", "rule").applyInPandas(choose, "stratum string, rule string, cutoff double, n_good long, n_rejected long, bound double")


def apply_rules(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """``(id, stratum, <features>, broken, keep)`` for each row; ``broken`` names the rules that reject it, with commas.

    Null strata count as the empty name; null and empty texts break no rule; strata without
    labelled documents, and all of them without labels, reject nothing.  Repeated rows are kept.
    """
    docs = spread(docs)
    features = checkpointed(
        docs.select(docs[f"`{id_col}`"].alias(id_col), F.coalesce(docs[f"`{stratum_col}`"].cast("string"), F.lit("")).alias("stratum"), F.md5(F.coalesce(docs[f"`{text_col}`"], F.lit(""))).alias("copy"), *[c.alias(n) for n, c in feature_columns(docs[f"`{text_col}`"]).items()])
    )
    chosen = checkpointed(
        thresholds(features, labels, risk, delta, id_col).groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == n, F.col("cutoff"))).alias(f"__{n}") for n in NAMES])
    )
    if chosen.count() <= MAX_BROADCAST_STRATA:
        chosen = F.broadcast(chosen)
    broken = F.array_compact(F.array(*[F.when(F.col(n) > F.col(f"__{n}"), F.lit(n)) for n in NAMES]))
    return features.join(chosen, "stratum", "left").select(f"`{id_col}`", "stratum", *NAMES, F.array_join(broken, ",").alias("broken"), (F.size(broken) == 0).alias("keep"))


def _oracle() -> str:
    """The same in DuckDB SQL."""
    alpha, rules = RISK / len(NAMES), ", ".join(f"('{n}')" for n in NAMES)
    value = "CASE rule " + " ".join(f"WHEN '{n}' THEN {n}" for n in NAMES) + " END"
    cut = lambda n: f"(SELECT cutoff FROM chosen c WHERE c.stratum = f.stratum AND c.rule = '{n}')"
    fails = ", ".join(f"CASE WHEN f.{n} > {cut(n)} THEN '{n}' END" for n in NAMES)
    return f"""WITH t AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, stratum, t, length(t) AS n, len(string_split_regex(t, '\\s+')) AS w, len(list_distinct(string_split_regex(t, '\\s+'))) AS dw, len(string_split(t, chr(10))) AS l, len(list_distinct(string_split(t, chr(10)))) AS dl FROM t),
f AS (SELECT doc_id, stratum, md5(t) AS copy,
 CASE WHEN n > 0 THEN length(regexp_replace(t, '[\\p{{L}}\\p{{N}}\\s.,;:?''"()\\-]', '', 'g'))::DOUBLE / n ELSE 0.0 END AS symbols,
 CASE WHEN n > 0 THEN (n - length(regexp_replace(t, '\\p{{Lu}}', '', 'g')))::DOUBLE / n ELSE 0.0 END AS capitals,
 CASE WHEN w >= 8 THEN round(1 - ln(dw::DOUBLE) / ln(w::DOUBLE), 9) ELSE 0.0 END AS sameness,
 (l - dl)::DOUBLE / l AS line_repeats FROM w),
good AS (SELECT DISTINCT stratum, copy, {", ".join(NAMES)} FROM f JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) g ON g.doc_id = f.doc_id),
b AS (SELECT stratum, rule, least({len(GRID)}, greatest(0, ceil(round({value} * 200, 9)) - 2))::INT AS beyond FROM good, (VALUES {rules}) r(rule)),
fam AS (SELECT count(DISTINCT stratum) * {len(NAMES)} AS families FROM good),
k AS (SELECT b.stratum, b.rule, g, count(*) AS n, count(*) FILTER (WHERE beyond > g) AS k FROM b, (SELECT unnest(range({len(GRID)})) AS g) GROUP BY ALL),
p AS (SELECT stratum, rule, g, CASE WHEN k >= n THEN 1.0 ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({alpha}::DOUBLE) + (n - i) * ln(1 - {alpha}::DOUBLE))) FROM (SELECT unnest(range(k + 1)) AS i)) END AS p FROM k),
stop AS (SELECT stratum, rule, coalesce(max(g) FILTER (WHERE p > {DELTA} / families), -1) AS g FROM p, fam GROUP BY stratum, rule),
chosen AS (SELECT stratum, rule, (g + 3) / 200.0::DOUBLE AS cutoff FROM stop WHERE g < {len(GRID) - 1}),
x AS (SELECT f.*, list_filter([{fails}], lambda y: y IS NOT NULL) AS broken FROM f)
SELECT doc_id, stratum, {", ".join(NAMES)}, array_to_string(broken, ',') AS broken, len(broken) = 0 AS keep FROM x"""


ORACLE_SQL = _oracle().replace("\\\\", "\\")
