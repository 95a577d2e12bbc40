"""Operator 4: document fingerprints as quartile bucket digests.

A window of five bytes slides over the text; six triplets of each window are hashed into 128
buckets.  The digest encodes, for each bucket, in which quartile of all bucket counts its
count lies (two bits), and in its head a checksum, the logarithm of the length and the
quartiles' ratios: 35 bytes, as 70 hexadecimal digits.  Two digests' difference score adds the
buckets' distances and the heads' and is bounded by :data:`MAX_DIFFERENCE` (after Oliver, Cheng
and Chen, "TLSH - A Locality Sensitive Hash", 2013).

Digests that differ by at most :data:`LINK` are linked, and the search for them is exact.  The
buckets are a ring of LINK + 1 bands.  A score of LINK leaves some band equal from which on each
chain of c bands differs by at most c x LINK / (LINK + 1), rounded down (Qin and Xiao, "Pigeonring",
2018): so of the next band, which may differ by 1, one half is equal too.  Digests meet under a band
and a half of the next, and the whole score is taken where they meet.  Equal digests are one
class, so that thousands of copies cost no more than one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import checkpointed, pick
from corvane.llm.simhash import components
from corvane.session import spread

BUCKETS = 128
#: A window's triplets: all pairs with its first byte but the farthest combinations, each with a salt.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 2, 4), (0, 1, 4), (0, 3, 4))
#: Texts of fewer bytes have too few triplets for quartiles to mean anything.
LEAST_BYTES = 50
HEAD_LIMIT = 120
#: Digests that differ by so much at most are linked.
LINK = 8
#: 6 for each bucket at most, and the head's share.
MAX_DIFFERENCE = BUCKETS * 6 + HEAD_LIMIT

_mix = np.random.RandomState(20240229).permutation(256).astype(np.uint8)
#: By salt and the first two bytes, the hash so far.
_PAIR = np.stack([_mix[_mix[np.arange(256, dtype=np.uint8)[:, None] ^ _mix[s + 1]] ^ np.arange(256, dtype=np.uint8)[None, :]].reshape(-1) for s in range(len(TRIPLETS))])
_CHUNK = 1 << 20


def bucket_counts(data: bytes) -> np.ndarray:
    """How many of a text's triplets fall into each bucket."""
    x = np.frombuffer(data, np.uint8)
    counts = np.zeros(256, np.int64)
    for at in range(0, max(0, len(x) - 4), _CHUNK):  # windows by chunks, so that long texts need little memory
        part = x[at : at + _CHUNK + 4]
        n = len(part) - 4
        wide = part.astype(np.uint16) << 8
        for s, (i, j, k) in enumerate(TRIPLETS):
            h = _mix[_PAIR[s][wide[i : i + n] | part[j : j + n]] ^ part[k : k + n]]
            counts += np.bincount(h, minlength=256)
    return counts[:BUCKETS] + counts[BUCKETS:]


def digest(data: bytes | None) -> str | None:
    """A text's digest; none for a null text, for one of fewer than :data:`LEAST_BYTES` bytes, and
    for one that fills no more than half of the buckets (as one byte repeated does): its quartiles
    say nothing, and all such texts would look alike."""
    if data is None or len(data) < LEAST_BYTES:
        return None
    counts = bucket_counts(data)
    q = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    if not q[1]:
        return None
    code = (counts[:, None] > q[None, :]).sum(1).astype(np.uint8)
    body = (code.reshape(-1, 4) << np.array([6, 4, 2, 0], np.uint8)).sum(1).astype(np.uint8)
    x = np.frombuffer(data, np.uint8)
    check = int(_mix[np.bitwise_xor.reduce(_mix[(x ^ (np.arange(len(x)) & 255).astype(np.uint8))])])
    length = int(np.log(len(data)) / np.log(1.1)) & 255
    ratios = (int(q[0] * 15 // max(q[2], 1)) << 4) | int(q[1] * 15 // max(q[2], 1))
    return bytes([check, length, ratios]).hex() + body.tobytes().hex()


_CODES = (np.arange(256)[:, None] >> np.array([6, 4, 2, 0])) & 3
_GAP = np.abs(_CODES[:, None, :] - _CODES[None, :, :])
#: Of two bytes of the body: 1 and 2 for neighbouring and next quartiles, 6 for opposite ones.
_DISTANCE = np.where(_GAP == 3, 6, _GAP).sum(2).astype(np.int64)


def differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Difference scores of digests given as rows of 35 bytes."""
    body = _DISTANCE[a[:, 3:], b[:, 3:]].sum(1)
    wrap = lambda x, y, size: np.minimum((x - y) % size, (y - x) % size)
    p, q = a[:, :3].astype(np.int64), b[:, :3].astype(np.int64)
    length = wrap(p[:, 1], q[:, 1], 256)
    head = np.where(length <= 1, length, 2 * length) + (p[:, 0] != q[:, 0])
    for shift in (4, 0):
        gap = wrap(p[:, 2] >> shift & 15, q[:, 2] >> shift & 15, 16)
        head += np.where(gap <= 1, gap, (gap - 1) * 4)
    return body + np.minimum(head, HEAD_LIMIT)


def difference(a: str | None, b: str | None) -> int | None:
    """The difference score of two digests: 0 to :data:`MAX_DIFFERENCE`; none if either is missing."""
    if a is None or b is None:
        return None
    rows = [np.frombuffer(bytes.fromhex(x), np.uint8)[None, :] for x in (a, b)]
    return int(differences(*rows)[0])


def difference_column(left: Column, right: Column) -> Column:
    """:func:`difference` of two columns, in one pass over each batch."""

    @F.pandas_udf("int")
    def scores(a: pd.Series, b: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(a), dtype="Int32")
        both = np.flatnonzero((a.notna() & b.notna()).to_numpy())
        if len(both):
            rows = [np.frombuffer(bytes.fromhex("".join(x.to_numpy()[both])), np.uint8).reshape(len(both), -1) for x in (a, b)]
            out.iloc[both] = differences(*rows)
        return out

    return scores(left, right)


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, digest)`` for each row of ``docs``.

    Null texts have nulls; texts that are too short or too uniform a null digest (:func:`digest`).
    Repeated rows are kept; other columns are ignored.
    """
    return _prints(docs, id_col, text_col).select(f"`{id_col}`", "n_bytes", "digest")


#: A digest as numbers: the body's 128 codes in four longs, and the head.
_CODED = ("c0", "c1", "c2", "c3", "head")


def _prints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    names = [id_col, "n_bytes", "digest", *_CODED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else t.encode() for t in (x.as_py() for x in batch.column(1))]
            digests = [digest(t) for t in texts]
            raw = [None if d is None else bytes.fromhex(d) for d in digests]
            coded = np.array([np.frombuffer(r[3:] if r else bytes(32), ">i8") for r in raw]).astype(np.int64).reshape(-1, 4)
            none = np.array([r is None for r in raw], bool)
            head = np.array([int.from_bytes(r[:3], "big") if r else 0 for r in raw], np.int64)
            columns = [pa.array(x, pa.int64(), mask=none) for x in (*coded.T, head)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if t is None else len(t) for t in texts], pa.int64()), pa.array(digests, pa.string()), *columns], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return spread(pick(docs, id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, digest string, {', '.join(f'{c} long' for c in _CODED)}")


def score_sql(a: str, b: str) -> str:
    """:func:`difference` of two digests as SQL over their columns ``<a>c0`` to ``<a>head``.

    A code's two bits are turned into three that say whether it exceeds 0, 1 and 2, so the
    differing ones count a gap; a gap of 3 differs in all of them and counts 3 more.
    """
    low = "6148914691236517205L"  # every second bit
    parts = []
    for i in range(4):
        bits = {n: (f"(shiftrightunsigned({n}c{i}, 1) & {low})", f"({n}c{i} & {low})") for n in (a, b)}
        x1, x2, x3 = (f"({f(*bits[a])} ^ {f(*bits[b])})" for f in (lambda h, l: f"({h} | {l})", lambda h, l: h, lambda h, l: f"({h} & {l})"))
        parts.append(f"bit_count({x1}) + bit_count({x2}) + bit_count({x3}) + 3 * bit_count({x1} & {x2} & {x3})")
    field = lambda n, shift, mask: f"(shiftrightunsigned({n}head, {shift}) & {mask}L)"
    ring = lambda shift, size: f"least(pmod({field(a, shift, size - 1)} - {field(b, shift, size - 1)}, {size}), pmod({field(b, shift, size - 1)} - {field(a, shift, size - 1)}, {size}))"
    length = ring(8, 256)
    head = [f"CASE WHEN {length} <= 1 THEN {length} ELSE 2 * {length} END", f"CAST({field(a, 16, 255)} <> {field(b, 16, 255)} AS INT)"]
    head += [f"CASE WHEN {g} <= 1 THEN {g} ELSE ({g} - 1) * 4 END" for g in (ring(4, 16), ring(0, 16))]
    return f"CAST({' + '.join(parts)} + least({' + '.join(head)}, {HEAD_LIMIT}) AS INT)"


def _meetings(link: int) -> list[str]:
    """SQL for the values under which a digest is found: a band and a half of the next, by their hexadecimal digits."""
    bands = link + 1
    edge = [round(i * BUCKETS / 2 / bands) for i in range(bands + 1)]
    out = []
    for k in range(bands):
        first, last = edge[(k + 1) % bands], edge[(k + 1) % bands + 1]
        mid = (first + last) // 2
        for x, y in ((first, mid), (mid, last)):
            out.append(f"xxhash64({k}, {x}, substring(digest, {7 + edge[k]}, {edge[k + 1] - edge[k]}), substring(digest, {7 + x}, {y - x}))")
    return out


def linked_digests(classes: DataFrame, link: int = LINK) -> DataFrame:
    """``(a, b, difference)``, a < b: all pairs of ``classes`` ``(node, digest, c0, ..., head)`` that differ by at most ``link`` (31 at most)."""
    if not 0 <= link < BUCKETS // 4:
        raise ValueError("bands have to hold at least four buckets")
    entered = classes.select("node", *_CODED, F.explode(F.expr(f"array({', '.join(_meetings(link))})")).alias("entry"))
    a, b = (entered.select("entry", *[F.col(c).alias(f"{n}_{c}") for c in ("node", *_CODED)]) for n in "ab")
    met = a.join(b, "entry").where(F.col("a_node") < F.col("b_node")).withColumn("difference", F.expr(score_sql("a_", "b_")))
    return met.where(F.col("difference") <= link).groupBy(F.col("a_node").alias("a"), F.col("b_node").alias("b")).agg(F.first("difference").alias("difference"))


def group_documents(docs: DataFrame, link: int = LINK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, digest, class_id, n_links, group_id)`` for each row of ``docs``.

    ``class_id`` is the least id of the rows with the same digest, ``n_links`` the number of other
    digests within ``link`` of it, ``group_id`` the least id that links lead to.  Rows without a
    digest or without an id are their own class and group and have no links.  Repeated rows are kept.
    """
    prints = checkpointed(_prints(docs, id_col, text_col).withColumnRenamed(id_col, "__id"))
    held = prints.where("digest IS NOT NULL AND __id IS NOT NULL")
    classes = checkpointed(held.groupBy("digest").agg(F.min("__id").alias("node"), *[F.first(c).alias(c) for c in _CODED]))
    pairs = checkpointed(linked_digests(classes, link).select("a", "b"))
    roots = components(pairs)
    links = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    named = classes.select("digest", "node").join(roots, "node", "left").join(links, "node", "left").select("digest", F.col("node").alias("class_id"), "n_links", F.coalesce("root", "node").alias("group_id"))
    mine = lambda c, other: F.coalesce(F.when(F.col("__id").isNotNull(), F.col(c)), other).alias(c)
    both = prints.join(named, "digest", "left")
    return both.select(F.col("__id").alias(id_col), "n_bytes", "digest", mine("class_id", F.col("__id")), mine("n_links", F.lit(0)), mine("group_id", F.col("__id")))


def compare(pairs: DataFrame, left: Column, right: Column, name: str = "difference") -> DataFrame:
    """``pairs`` with the difference score of two digest columns."""
    return pairs.withColumn(name, difference_column(left, right))
