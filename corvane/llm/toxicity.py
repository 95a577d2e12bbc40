"""Operator 9: toxicity by weak supervision.

Many voters look at a document: lexicons of insults, patterns (disguised spellings, insults
aimed at "you") and word families.  Each votes or abstains; none is trusted as such.

A generative label model explains the votes' joint distribution over *all* documents: a hidden
class and, given it, voters in a tree (Chow and Liu), so that a voter depends on the class and
on the voter most correlated with it beyond the class.  EM on the counts of vote patterns (a
grouped aggregation with one row for each pattern that occurs) estimates the class's prior, the
voters' accuracies and the tree's correlations.

A linear classifier over hashed words and word beginnings is then trained on the model's
posteriors and scores every document, also where no voter speaks.

The word families come from a bounded sample of labelled documents: word beginnings that are
far more frequent in toxic ones.

Samples are of distinct texts, bounded in number and in characters, and are worked on by the
executors: the driver only gets counts of word beginnings and hashed features.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import checkpointed, pick, text_batches
from corvane.session import spread

#: Labelled texts that word families are taken from, and texts that the classifier is trained on, at most.
MAX_LABELLED, MAX_TRAINING = 8_000, 8_000
#: Either sample has at most so many characters; texts beyond, in the order of a hash, aren't trained on.
MAX_SAMPLE_CHARS = 32_000_000
FAMILIES = 400
HASH_BITS = 18
THRESHOLD = 0.5
MEMO_ENTRIES = 150_000

LEXICONS: dict[str, tuple[str, ...]] = {
    "stupidity": ("idiot", "idiots", "moron", "morons", "stupid", "imbecile", "dumb", "dumbass", "fool", "dimwit", "halfwit", "retard", "retarded"),
    "worth": ("loser", "losers", "worthless", "pathetic", "useless", "failure", "nobody", "wretch"),
    "filth": ("scum", "trash", "garbage", "filth", "filthy", "vermin", "pig", "swine", "rat", "cockroach", "disgusting", "vile", "gross"),
    "mockery": ("clown", "clowns", "joke", "freak", "creep", "weirdo", "jerk", "crybaby"),
    "swearing": ("fuck", "fucking", "fucker", "shit", "shitty", "bullshit", "bitch", "bastard", "asshole", "crap", "damn", "dick", "cunt", "whore", "slut"),
    "hatred": ("hate", "hateful", "despise", "loathe", "kill", "die", "hang", "burn", "exterminate"),
    "french": ("idiote", "connard", "connasse", "salope", "merde", "putain", "crétin", "abruti", "débile", "minable", "ordure", "enculé"),
    "german": ("trottel", "arschloch", "scheiße", "scheisse", "dummkopf", "schwachkopf", "versager", "abschaum", "depp", "hurensohn", "wichser", "miststück"),
    "spanish": ("idiota", "imbécil", "estúpido", "estúpida", "mierda", "cabrón", "puta", "pendejo", "basura", "tonto", "asqueroso", "gilipollas"),
}
#: Words that also occur in harmless prose; a lexicon needs another hit beside them.
_MILD = frozenset("nobody failure joke rat pig kill die hang burn hate damn gross fool trash".split())
_LEET = str.maketrans("013457@$!", "oieastasi")
_WORD = re.compile(r"\w+")
_CORE = frozenset(w for n in ("stupidity", "worth", "filth", "mockery", "swearing") for w in LEXICONS[n]) - _MILD
_AIMED = re.compile(r"\b(?:you(?:'re| are)?|your)\s+(?:\w+\s+){0,2}?(?:" + "|".join(sorted(_CORE)) + r")\b")
_DISGUISED = re.compile(r"(?<!\w)[^\W\d_]*[0-9@$!]+[^\W_][\w@$!]*")

VOTERS = (*LEXICONS, "two_insults", "aimed", "spelled_out", "disguised", "family_once", "family_twice", "family_often", "family_share")


class Voters:
    """The voters, given the word families."""

    def __init__(self, families: list[str]):
        self.families = frozenset(families)
        self.sizes = sorted({len(f) for f in families})
        self.lexicon: dict[str, int] = {}
        for k, words in enumerate(LEXICONS.values()):
            for w in words:
                self.lexicon[w] = self.lexicon.get(w, 0) | 1 << k
        self.memo: dict[str, tuple[int, int]] = {}

    def word(self, w: str) -> tuple[int, int]:
        """The lexicons a word is in, as a bit mask, and whether it belongs to a family (it must go on after it)."""
        got = self.memo.get(w)
        if got is None:
            family = any(w[:n] in self.families for n in self.sizes if len(w) >= n)
            got = (self.lexicon.get(w, 0), int(family))
            if len(self.memo) < MEMO_ENTRIES:
                self.memo[w] = got
        return got

    def votes(self, lowered: str) -> int:
        """The voters that call a text (in small letters) toxic, as a bit mask."""
        in_order = _WORD.findall(lowered)
        words = set(in_order)
        mask, strong, mild, hits = 0, 0, 0, 0
        memo = self.memo
        for w in words:
            lex, family = memo.get(w) or self.word(w)
            if lex:
                if w in _MILD:
                    mild |= lex
                else:
                    strong += 1
                    mask |= lex
            hits += family
        if strong:
            mask |= mild
            if _AIMED.search(lowered):
                mask |= 1 << len(LEXICONS) + 1
        at = len(LEXICONS)
        if strong >= 2:
            mask |= 1 << at
        if sum(len(w) == 1 for w in words) >= 3 and self._spelled(in_order):
            mask |= 1 << at + 2
        if any(x.translate(_LEET) in _CORE for x in _DISGUISED.findall(lowered)):
            mask |= 1 << at + 3
        for k, least in enumerate((1, 2, 4)):
            if hits >= least:
                mask |= 1 << at + 4 + k
        if hits >= 0.03 * len(words) and hits:
            mask |= 1 << at + 7
        return mask


    @staticmethod
    def _spelled(in_order: list[str]) -> bool:
        """Whether single letters in a row spell an insult."""
        run = ""
        for w in (*in_order, "--"):
            if len(w) == 1:
                run += w
            elif run:
                if len(run) > 3 and any(c in run for c in _CORE):
                    return True
                run = ""
        return False


def word_set(text: str) -> frozenset[str]:
    return frozenset(w for w in _WORD.findall(text.lower()) if w.isalpha())


def beginnings(words: frozenset[str]) -> list[str]:
    """The words' beginnings of 4 to 8 letters."""
    return sorted({w[:n] for w in words for n in range(4, 9) if len(w) >= n})


def chosen_families(counts: Iterable[tuple[str, int, int]], n_bad: int, n_good: int, most: int = FAMILIES) -> list[str]:
    """Of word beginnings ``(beginning, toxic texts, clean texts)`` those that mark toxic texts: in
    5 of them at least, and in at most a twentieth of the share of clean ones.  The shortest
    beginning stands for those that go on from it."""
    found = [(b, f) for f, b, g in counts if b >= 5 and (g + 0.5) / (n_good + 1) <= 0.05 * b / max(1, n_bad)]
    kept: list[str] = []
    held: set[str] = set()
    for _, f in sorted(found, key=lambda x: (len(x[1]), -x[0], x[1])):
        if not any(f[:n] in held for n in range(4, len(f))):
            kept.append(f)
            held.add(f)
    strength = {f: b for b, f in found}
    return sorted(kept, key=lambda f: (-strength[f], f))[:most]


def mine_families(sample: DataFrame, most: int = FAMILIES) -> list[str]:
    """The word families of ``sample`` ``(key, text, toxic)``; texts of the same words count once for each label.

    Beginnings are made and counted by the executors; only those of 5 toxic texts and more come to the driver.
    """

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [word_set(t) for t in batch.column(0).to_pylist()]
            keys = pa.array([zlib.crc32(" ".join(sorted(x)).encode()) << 20 | len(x) & (1 << 20) - 1 for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([keys, batch.column(1), pa.array([beginnings(x) for x in sets], pa.list_(pa.string()))], names=["words", "toxic", "starts"])

    each = sample.select("text", (F.col("toxic") > 0.5).alias("toxic")).mapInArrow(words, "words long, toxic boolean, starts array<string>")
    each = checkpointed(each.groupBy("words", "toxic").agg(F.first("starts").alias("starts")))
    n = {r["toxic"]: r["count"] for r in each.groupBy("toxic").count().collect()}
    counts = each.select("toxic", F.explode("starts").alias("f")).groupBy("f").agg(F.count_if("toxic").alias("b"), F.count_if(~F.col("toxic")).alias("g")).where("b >= 5")
    return chosen_families(sorted(map(tuple, counts.collect())), n.get(True, 0), n.get(False, 0), most)


class LabelModel:
    """The generative model of votes: class prior, and by class a tree of voters."""

    def __init__(self, n: int, edges_least: float = 1e-4):
        self.n, self.least = n, edges_least

    @staticmethod
    def bits(masks: np.ndarray, n: int) -> np.ndarray:
        return (masks[:, None] >> np.arange(n) & 1).astype(float)

    def fit(self, masks: np.ndarray, counts: np.ndarray, rounds: int = 60) -> LabelModel:
        """EM from the majority of voters: a document with any vote starts as likely toxic."""
        v, c = self.bits(masks, self.n), counts.astype(float)
        q = np.where(v.any(1), 1 - 0.5 ** v.sum(1), 0.01)
        self.parent = np.full(self.n, -1)
        for r in range(rounds):
            if r in (5, 20):
                self._tree(v, c, q)
            self._maximise(v, c, q)
            new = self.posterior(masks)
            if r > 25 and np.abs(new - q).max() < 1e-7:
                break
            q = new
        return self

    def _tree(self, v: np.ndarray, c: np.ndarray, q: np.ndarray) -> None:
        """The maximum spanning tree by mutual information given the class."""
        info = np.zeros((self.n, self.n))
        total = c.sum()
        for w in (c * q, c * (1 - q)):
            m = w.sum()
            if m <= 0:
                continue
            one = (w @ v + 0.5) / (m + 1)
            both = ((v * w[:, None]).T @ v + 0.25) / (m + 1)
            for i, j, p in ((1, 1, both), (1, 0, one[:, None] - both), (0, 1, one[None, :] - both), (0, 0, 1 - one[:, None] - one[None, :] + both)):
                p = np.clip(p, 1e-12, 1)
                a, b = (one if i else 1 - one)[:, None], (one if j else 1 - one)[None, :]
                info += m / total * p * np.log(p / np.clip(a * b, 1e-12, 1))
        self.parent[:] = -1
        joined, free = [0], set(range(1, self.n))
        self.order = [0]
        while free:
            x, k, p = max((info[p, k], -k, -p) for p in joined for k in free)
            k, p = -k, -p
            if x > self.least:
                self.parent[k] = p
            joined.append(k)
            free.discard(k)

    def _maximise(self, v: np.ndarray, c: np.ndarray, q: np.ndarray) -> None:
        self.prior = (c @ q + 1) / (c.sum() + 20)
        self.table = np.empty((2, self.n, 2))  # by class, voter and the parent's vote: the chance to vote
        for y, w in ((1, c * q), (0, c * (1 - q))):
            for k in range(self.n):
                for z in (0, 1):
                    rows = w if self.parent[k] < 0 else w * (v[:, self.parent[k]] == z)
                    # A voter is taken to be better than chance until the counts say otherwise.
                    self.table[y, k, z] = (rows @ v[:, k] + (0.5 if y else 0.05)) / (rows.sum() + 1)

    def posterior(self, masks: np.ndarray) -> np.ndarray:
        """P(toxic | votes) by vote pattern."""
        v = self.bits(masks, self.n)
        odds = np.full(len(v), np.log(self.prior / (1 - self.prior)))
        for k in range(self.n):
            z = np.zeros(len(v), int) if self.parent[k] < 0 else v[:, self.parent[k]].astype(int)
            p, q = self.table[1, k, z], self.table[0, k, z]
            odds += np.where(v[:, k] > 0, np.log(p / q), np.log((1 - p) / (1 - q)))
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


class Linear:
    """A logistic regression over hashed words and word beginnings, each distinct word counting once."""

    def __init__(self, weights: np.ndarray | None = None, bias: float = 0.0):
        self.w = np.zeros(1 << HASH_BITS, np.float32) if weights is None else weights
        self.b = bias
        self.memo: dict[str, float] = {}

    @staticmethod
    def slots(word: str) -> list[int]:
        """A word's features: itself and its beginnings of 5 to 8 letters."""
        names = [word] + [f"^{word[:n]}" for n in range(5, 9) if len(word) >= n]
        return [zlib.crc32(x.encode()) & (1 << HASH_BITS) - 1 for x in names]

    @classmethod
    def features(cls, text: str, cache: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """A text's slots, each once, with their values; ``cache`` holds words' slots."""
        flat: list[int] = []
        words = set(_WORD.findall(text.lower()))
        for w in words:
            got = cache.get(w)
            if got is None:
                got = cls.slots(w)
                if len(cache) < 50_000:
                    cache[w] = got
            flat += got
        r, n = np.unique(np.array(flat, np.int32), return_counts=True)
        return r, (n / np.sqrt(max(1, len(words)))).astype(np.float32)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, epochs: int = 6, rate: float = 0.5, ridge: float = 1e-5) -> Linear:
        """Adagrad on the cross entropy with soft labels over :meth:`features`."""
        grown = np.full(len(self.w), 1e-2, np.float32)
        grown_b, order = 1e-2, np.random.RandomState(0)
        for _ in range(epochs):
            for i in order.permutation(len(rows)):
                r, x = rows[i]
                p = 1 / (1 + np.exp(-np.clip(float(self.w[r] @ x) + self.b, -30, 30)))
                g = weight[i] * (p - y[i])
                if abs(g) < 1e-4:
                    continue
                step = g * x
                grown[r] += step * step
                self.w[r] -= rate * (step + ridge * self.w[r]) / np.sqrt(grown[r])
                grown_b += g * g
                self.b -= rate * g / np.sqrt(grown_b)
        return self

    def word(self, w: str) -> float:
        got = float(self.w[self.slots(w)].sum())
        if len(self.memo) < MEMO_ENTRIES:
            self.memo[w] = got
        return got

    def score(self, lowered: str) -> float:
        """P(toxic) of a text in small letters; words in a fixed order, so that sums are the same on every run."""
        words = sorted(set(_WORD.findall(lowered)))
        if not words:
            return 0.0
        each = list(map(self.memo.get, words))
        if None in each:
            each = [self.word(w) if x is None else x for w, x in zip(words, each)]
        return float(1 / (1 + np.exp(-np.clip(sum(each) / np.sqrt(len(words)) + self.b, -30, 30))))


def first_keys(keys: DataFrame, most: int, max_chars: int) -> DataFrame:
    """At most ``most`` of ``keys`` ``(key, n, <others>)``, which are distinct, in the order of a hash
    until ``max_chars`` is reached; ``n`` is the length of the key's text in characters."""
    first = keys.orderBy(F.xxhash64("key"), "key").limit(most)
    return first.withColumn("upto", F.sum("n").over(Window.orderBy(F.xxhash64("key"), "key"))).where(F.col("upto") <= max_chars).drop("upto", "n")


def sampled(texts: DataFrame, first: DataFrame) -> DataFrame:
    """``(key, text, <others>)``: one row for each of ``first``, however many rows hold its text."""
    return texts.select("key", "text").join(F.broadcast(first), "key").groupBy("key").agg(F.min("text").alias("text"), *[F.first(c).alias(c) for c in first.columns if c != "key"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED, max_training: int = MAX_TRAINING, max_chars: int = MAX_SAMPLE_CHARS) -> Linear:
    """Votes of all documents, the label model on their counts, and the classifier on a bounded sample of posteriors.

    Samples are taken in the order of a hash: of the labelled texts for the word families, and
    of distinct texts for the classifier, half of them with votes and half without, weighted by
    the rows that they stand for.  Of conflicting labels "toxic" counts.
    """
    spark, at = docs.sparkSession, F.col(f"`{id_col}`")
    docs = spread(docs)
    texts = docs.where(docs[f"`{text_col}`"].isNotNull()).select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text"), F.xxhash64(docs[f"`{text_col}`"]).alias("key"))
    marked = pick(labels, id_col, "toxic").where(at.isNotNull() & F.col("toxic").isNotNull()).groupBy(at.alias("id")).agg(F.max("toxic").alias("toxic"))
    marked = texts.join(F.broadcast(marked.orderBy(F.xxhash64("id"), "id").limit(max_labelled)), "id")
    marked = marked.groupBy("key").agg(F.max(F.length("text")).alias("n"), F.max("toxic").alias("toxic"))
    families = spark.sparkContext.broadcast(mine_families(sampled(texts, first_keys(marked, max_labelled, max_chars))))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(families.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([voters.votes(t.as_py().lower()) for t in part.column(2)], pa.int32())], names=["key", "n", "votes"])

    with text_batches(spark):
        votes = checkpointed(texts.select("key", F.length("text").alias("n"), "text").mapInArrow(vote, "key long, n int, votes int"))
    counts = votes.groupBy("votes").count().toPandas().sort_values("votes")  # at most one row for each vote pattern
    masks, n = counts["votes"].to_numpy(np.int64), counts["count"].to_numpy(np.int64)
    if not n.sum() or not (masks > 0).any():
        return Linear(bias=-10.0)
    model = LabelModel(len(VOTERS)).fit(masks, n)
    distinct = votes.groupBy("key").agg(F.first("n").alias("n"), F.first("votes").alias("votes"))
    some, none = (first_keys(distinct.where(test), max_training // 2, max_chars // 2) for test in ("votes <> 0", "votes = 0"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, list[int]] = {}
        for batch in batches:
            rows = [Linear.features(t, cache) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.astype("<i4").tobytes() for r, _ in rows], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, x in rows], pa.binary())], names=["key", "votes", "slots", "x"])

    rows = sampled(texts, some.unionByName(none)).select("key", "votes", "text").mapInArrow(features, "key long, votes int, slots binary, x binary").toPandas().sort_values("key", ignore_index=True)
    voted = rows["votes"].to_numpy() > 0
    stands = [n[(masks > 0) == some].sum() / max(1, (voted == some).sum()) for some in (False, True)]
    y = model.posterior(rows["votes"].to_numpy(np.int64))
    weight = np.where(voted, stands[True], stands[False])
    weight = weight / max(weight.mean(), 1e-9)
    return Linear().fit([(np.frombuffer(r, "<i4"), np.frombuffer(x, "<f4")) for r, x in zip(rows["slots"], rows["x"])], y, weight)


def _sent(docs: DataFrame, linear: Linear):
    """The classifier, in half a megabyte or so, for the executors."""
    at = np.flatnonzero(linear.w)
    return docs.sparkSession.sparkContext.broadcast((at, linear.w[at], linear.b))


def _received(sent) -> Linear:
    at, w, b = sent.value
    weights = np.zeros(1 << HASH_BITS, np.float32)
    weights[at] = w
    return Linear(weights, b)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score, toxic)`` for each row of ``docs``.

    A null text has nulls; a text without words scores 0.  Repeated rows are kept.  With an
    empty table, or no votes at all, nothing is toxic.
    """
    sent = _sent(docs, train(docs, labels, id_col, text_col))
    names = [id_col, "score", "toxic"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        linear = _received(sent)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                p = [None if t is None else linear.score(t.lower()) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if x is None else round(x, 6) for x in p], pa.float64()), pa.array([None if x is None else x >= threshold for x in p], pa.bool_())], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return spread(pick(docs, id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, score double, toxic boolean")


def keep_harmless(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't toxic, with all their columns; null texts stay.

    Of an empty table, or where no voter speaks (as without labels and insults), all rows stay.
    """
    sent = _sent(docs, train(docs, labels, id_col, text_col))
    docs = spread(docs)

    @F.pandas_udf("boolean")
    def harmless(texts: pd.Series) -> pd.Series:
        linear = _received(sent)
        return pd.Series([t is None or linear.score(t.lower()) < threshold for t in texts], dtype="boolean")

    return docs.where(harmless(docs[f"`{text_col}`"]))
