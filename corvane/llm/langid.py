"""Operator 7: language identification by a byte convolutional network.

Bytes are embedded, convolved with filters of several widths, max-pooled over a window and
classified by softmax.  The network is trained here, in numpy, on windows of labelled texts.
To apply it, a text is cut into windows of a fixed length that together cover all of it, and
the windows' log probabilities are averaged by length.

An embedding followed by a filter is a sum of table entries, one for each byte of the filter's
width; for the scan they are merged into tables by pairs of bytes, so a filter of width four
costs two look-ups.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import checkpointed, pick
from corvane.session import spread

#: At most so many labelled texts of each language are trained on, taken in the order of a hash, copies once.
TEXTS_EACH = 400
#: At most so many in all: with more than 200 languages each has fewer, and none is left out.
MAX_TEXTS = 80_000
#: Languages with fewer labelled texts are not learned.
LEAST_TEXTS = 5
#: A table of at most so many languages is broadcast; a larger one is joined by shuffle.
MAX_BROADCAST_LANGUAGES = 50_000
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS, EMBEDDING = 8, 8
BATCH_WINDOWS = 512

#: ASCII capitals as small letters, so that texts in capitals are read alike.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def windows(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A text's windows, the last padded with zeros, and how many bytes each has; none for an empty text."""
    x = _FOLD[np.frombuffer(data, np.uint8)]
    n = -(-len(x) // WINDOW)
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(x)] = x
    return out.reshape(n, WINDOW), np.minimum(WINDOW, len(x) - WINDOW * np.arange(n))


class Network:
    """The network's parameters: embedding, filters and biases by width, and the softmax layer."""

    def __init__(self, languages: list[str], seed: int = 0):
        rng = np.random.RandomState(seed)
        self.languages = languages
        self.e = rng.normal(0, 0.5, (256, EMBEDDING))
        self.f = [rng.normal(0, 1 / np.sqrt(w * EMBEDDING), (w, EMBEDDING, FILTERS)) for w in WIDTHS]
        self.b = [np.zeros(FILTERS) for _ in WIDTHS]
        self.w = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages)))
        self.c = np.zeros(len(languages))

    def parameters(self) -> list[np.ndarray]:
        return [self.e, *self.f, *self.b, self.w, self.c]

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, rate: float = 0.01, seed: int = 1) -> None:
        """Adam on the cross entropy; ``x`` windows, ``y`` language numbers."""
        rng, ps = np.random.RandomState(seed), self.parameters()
        m, v, t = [np.zeros_like(p) for p in ps], [np.zeros_like(p) for p in ps], 0
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
                t += 1
                for p, g, a, b in zip(ps, self._gradients(x[rows], y[rows]), m, v):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        n, emb = len(x), self.e[x]
        pooled, where = [], []
        for f, b, w in zip(self.f, self.b, WIDTHS):
            z = sum(emb[:, j : x.shape[1] - w + 1 + j] @ f[j] for j in range(w)) + b
            at = z.argmax(1)
            where.append(at)
            pooled.append(np.take_along_axis(z, at[:, None, :], 1)[:, 0])
        h = np.concatenate(pooled, 1)
        r = np.maximum(h, 0)
        s = r @ self.w + self.c
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), y] -= 1
        p /= n
        dh = (p @ self.w.T) * (h > 0)
        de, df, db = np.zeros_like(self.e), [np.zeros_like(f) for f in self.f], []
        for k, w in enumerate(WIDTHS):
            d = dh[:, k * FILTERS : (k + 1) * FILTERS]
            db.append(d.sum(0))
            for j in range(w):
                bytes_ = np.take_along_axis(x, where[k] + j, 1)  # the byte under each filter's maximum
                df[k][j] = np.einsum("nfe,nf->ef", self.e[bytes_], d)
                np.add.at(de, bytes_, d[:, :, None] * self.f[k][j].T[None])
        return [de, *df, *db, r.T @ p, p.sum(0)]

    def tables(self) -> list[list[tuple[int, np.ndarray]]]:
        """By width: pairs of an offset and a table, by two bytes (65,536 rows) or one (256 rows)."""
        out = []
        for f, b, w in zip(self.f, self.b, WIDTHS):
            one = [(self.e @ f[j]).astype(np.float32) for j in range(w)]
            one[0] = one[0] + b.astype(np.float32)
            each = [(j, (one[j][:, None, :] + one[j + 1][None, :, :]).reshape(65536, FILTERS)) for j in range(0, w - 1, 2)]
            out.append(each + ([(w - 1, one[w - 1])] if w % 2 else []))
        return out

    def dump(self) -> bytes:
        to = io.BytesIO()
        np.savez(to, *self.parameters(), languages=np.array(self.languages))
        return to.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Network:
        held = np.load(io.BytesIO(data))
        net = cls([str(x) for x in held["languages"]])
        for i, p in enumerate(net.parameters()):
            p[...] = held[f"arr_{i}"]
        return net


class Applier:
    """Applies a network to many windows at once."""

    def __init__(self, net: Network):
        self.languages, self.tables = net.languages, net.tables()
        self.w, self.c = net.w.astype(np.float32), net.c.astype(np.float32)

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.languages)), np.float32)
        for at in range(0, len(x), BATCH_WINDOWS):
            part = x[at : at + BATCH_WINDOWS]
            pairs = part[:, :-1].astype(np.uint16) << 8 | part[:, 1:]
            pooled = []
            for w, tables in zip(WIDTHS, self.tables):
                n, z = WINDOW - w + 1, None
                for j, table in tables:
                    got = table.take((pairs if len(table) == 65536 else part)[:, j : j + n], axis=0)
                    z = got if z is None else np.add(z, got, out=z)
                pooled.append(z.max(1))
            s = np.maximum(np.concatenate(pooled, 1), 0) @ self.w + self.c
            top = s.max(1, keepdims=True)
            out[at : at + len(part)] = s - top - np.log(np.exp(s - top).sum(1, keepdims=True))
        return out

    def identify(self, texts: list[str | None]) -> tuple[list[str | None], list[float | None]]:
        """Language and confidence by text; windows of many texts go through the network together."""
        names: list[str | None] = [None] * len(texts)
        sure: list[float | None] = [None] * len(texts)
        held, size = [], 0

        def flush() -> None:
            x, n = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]).astype(np.float32)
            logs = self.log_probabilities(x) * n[:, None]
            starts = np.cumsum([0, *(len(h[1]) for h in held)])[:-1]
            means = np.add.reduceat(logs, starts) / np.add.reduceat(n, starts)[:, None]
            p = np.exp(means - means.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            for (i, _, _), best, row in zip(held, p.argmax(1), p):
                names[i], sure[i] = self.languages[best], round(float(row[best]), 6)

        for i, t in enumerate(texts):
            if t:
                held.append((i, *windows(t.encode())))
                size += len(held[-1][1])
                if size >= 4 * BATCH_WINDOWS:
                    flush()
                    held, size = [], 0
        if held:
            flush()
        return names, sure


def train(docs: DataFrame, texts_each: int = TEXTS_EACH, text_col: str = "text", lang_col: str = "lang", max_texts: int = MAX_TEXTS) -> Network | None:
    """A network from at most ``texts_each`` texts of each language; none if no language has enough.

    Labels that occur fewer than :data:`LEAST_TEXTS` times, in the corpus or in the sample, are left
    out; all others are learned.  Equal texts of a language count once, whatever their ids.  Where
    the network finds two languages equally likely, the first name is taken.
    """
    lang, text = docs[f"`{lang_col}`"].cast("string"), docs[f"`{text_col}`"]
    rows = docs.where((F.length(text) > 0) & lang.isNotNull()).select(lang.alias("lang"), text.alias("text"), F.xxhash64(text).alias("h"))
    # Enough of the least hashes by language come from a threshold on the hash, so that just those
    # rows are ranked; four windows spread over the whole text, fewer where they would be the same.
    known = checkpointed(rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("d")).where(F.col("n") >= LEAST_TEXTS).drop("n"))
    n_known = known.count()
    if not n_known:
        return None
    texts_each = max(LEAST_TEXTS, min(texts_each, max_texts // n_known))
    starts = f"array_distinct(transform(sequence(0, 3), i -> cast(floor(i * greatest(0, length(text) - {WINDOW}) / 3) as int) + 1))"
    low = F.pmod("h", F.lit(1 << 30)) <= (1 << 30) * (4 * texts_each + 100) / F.col("d")
    some = rows.join(F.broadcast(known) if n_known <= MAX_BROADCAST_LANGUAGES else known, "lang").where(low)
    once = some.select("lang", "h", F.expr(f"transform({starts}, s -> substring(text, s, {WINDOW}))").alias("texts")).groupBy("lang", "h").agg(F.first("texts").alias("texts"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))
    rows = once.withColumn("nth", nth).where(F.col("nth") <= texts_each).select("lang", "nth", "texts").toPandas()
    rows = rows.assign(texts=[list(t) for t in rows["texts"]]).sort_values(["lang", "nth"], ignore_index=True)
    counts = rows["lang"].value_counts()
    languages = sorted(counts[counts >= LEAST_TEXTS].index)
    if not languages:
        return None
    xs, ys = [], []
    for lang_no, name in enumerate(languages):
        for texts in rows.loc[rows["lang"] == name, "texts"]:
            x = np.concatenate([windows(t.encode())[0][:1] for t in texts])
            if len(texts) > 1:  # short texts are to be known too
                x = np.concatenate([x, np.where(np.arange(WINDOW) < 40, x[:1], 0).astype(np.uint8)])
            xs.append(x)
            ys.append(np.full(len(x), lang_no))
    net = Network(languages)
    net.train(np.concatenate(xs), np.concatenate(ys))
    return net


def identify_documents(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, language, confidence)`` for each row of ``docs``.

    Null and empty texts have nulls, as have all if there is no network.  Repeated rows are kept.
    """
    names = [id_col, "language", "confidence"]
    kind = docs.schema[id_col].dataType.simpleString()
    if net is None:
        return pick(docs, id_col).select(f"`{id_col}`", F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("confidence"))
    sent = docs.sparkSession.sparkContext.broadcast(net.dump())  # some 10 kB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        applier = Applier(Network.load(sent.value))
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                found, sure = applier.identify(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.string()), pa.array(sure, pa.float64())], names=names)

    return spread(pick(docs, id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, language string, confidence double")
