"""Operator 8: near-duplicates by SimHash, with an exact search for links.

A document's fingerprint has 128 bits: the signs of the sums, over its distinct words, of the
words' hashes as vectors of +1 and -1.  Documents are near-duplicates if their fingerprints
differ in at most ``TAU`` bits.

All links are found.  The fingerprint is cut into 7 parts of 18 or 19 bits; if two differ in at most
TAU = 20 bits, they differ in at most 2 of one part, as 3 in each would make 21 (the pigeonhole
principle; for other thresholds see :func:`parts`).  Fingerprints are dealt to blocks and each two
blocks compared in one task, which looks up, part by part, all values within 2 bits and counts the
whole distance of what it meets, or compares all with all where that is cheaper.  A block holds at
most ``BLOCK_ROWS``, so memory is bounded; rows are sent once for every block there is.  The work
grows with the square of the fingerprints, by a factor of some 1/200: that many pairs are alike
enough in a part by chance.

:func:`entered` with its probes is an approximate key of an index by segments.  No query uses it.

Documents with equal fingerprints are one node from the start, so thousands of copies cost no
more than one.  Groups are the connected components, found by repeatedly joining every node to
the least neighbour of its neighbourhood (alternating stars); between rounds the edges are
checkpointed.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import checkpointed, fresh, pick, text_batches
from corvane.session import spread

TAU = 20
SEGMENTS, WIDTH = 4, 32
#: Of a segment's bits so many of the least certain ones may be turned, in so many sets.
UNCERTAIN, PROBES = 12, 40
#: The sets, by rank: the likeliest first, as if a bit's certainty grew with its rank.
SETS = sorted((c for n in range(4) for c in itertools.combinations(range(UNCERTAIN), n)), key=lambda c: (sum(r + 2 for r in c), len(c), c))[:PROBES]
#: Fingerprints are cut into so many parts at least, so that a part's values fit a table.
LEAST_PARTS, MOST_WIDTH = 7, 20
#: A block has so many fingerprints at most; fewer make up to ``BLOCKS`` blocks of ``SMALL_BLOCK``.
BLOCK_ROWS, BLOCKS, SMALL_BLOCK = 500_000, 6, 4_096
#: Candidates held at a time.
CHUNK = 1 << 18
#: What numpy takes for one lookup, one candidate and one compared pair, about; they only choose between two exact ways.
NS_LOOKUP, NS_CANDIDATE, NS_COMPARED = 25, 50, 10
_WORD = re.compile(r"\w+")


def sums(text: str) -> np.ndarray | None:
    """By bit, words with the bit set less words without; none for a text without words.

    White space and case don't count.  A text of only punctuation takes its characters' runs
    as words.
    """
    lowered = text.lower()
    words = list(set(_WORD.findall(lowered)) or set(lowered.split()))
    if not words:
        return None
    x = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint8).reshape(-1, 16)
    out = np.zeros(128, np.int64)
    for at in range(0, len(x), 4096):
        out += np.unpackbits(x[at : at + 4096], axis=1).sum(0, dtype=np.int64)
    return 2 * out - len(words)


def _halves(v: np.ndarray) -> np.ndarray:
    return np.packbits(v > 0, axis=1).view(">i8").astype(np.int64)


def signatures(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From rows of sums: the fingerprints' halves, two segments each, and by segment the places of its uncertain bits from its low end."""
    weak = np.argsort(np.abs(v).reshape(len(v), SEGMENTS, WIDTH), axis=2, kind="stable")[:, :, :UNCERTAIN]
    return _halves(v), WIDTH - 1 - weak


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", probes: bool = True) -> DataFrame:
    """``(id, hi, lo, weak)``: the fingerprint's halves and, for ``probes``, the bits to probe, a letter from A for each; null for texts without words."""
    names = [id_col, "hi", "lo", "weak"][: 3 + probes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = [None if t is None else sums(t) for t in part.column(1).to_pylist()]
                some = [i for i, r in enumerate(rows) if r is not None]
                hi, lo = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
                weak: list[str | None] = [None] * len(rows)
                if some:
                    v = np.stack([rows[i] for i in some])
                    halves, bits = signatures(v) if probes else (_halves(v), None)
                    hi[some], lo[some] = halves[:, 0], halves[:, 1]
                    for i, w in zip(some, (bits + 65).astype(np.uint8).reshape(len(some), -1) if probes else ()):
                        weak[i] = w.tobytes().decode()
                none = np.array([r is None for r in rows], bool)
                columns = [part.column(0), pa.array(hi, pa.int64(), mask=none), pa.array(lo, pa.int64(), mask=none), pa.array(weak, pa.string())]
                yield pa.RecordBatch.from_arrays(columns[: len(names)], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return spread(pick(docs, id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, hi long, lo long" + ", weak string" * probes)


def _segment(k: int, of: str = "") -> str:
    """A segment's value as SQL over ``hi`` and ``lo`` (or what is put in their place)."""
    half = (of or "{}").format("hi" if k < 2 else "lo")
    return f"shiftrightunsigned({half}, {WIDTH})" if k % 2 == 0 else f"({half} & {(1 << WIDTH) - 1}L)"


def entered(nodes: DataFrame) -> DataFrame:
    """``(entry, node, turned)``: where nodes ``(node, hi, lo, weak)`` meet.

    An entry is a segment's number and its value with a set of bits turned; ``turned`` holds
    these bits in its upper half and the next segment in its lower one.
    """
    each = [f"named_struct('at', {k << WIDTH}L | {_segment(k)}, 'next', {_segment((k + 1) % SEGMENTS)}, 'k', {k})" for k in range(SEGMENTS)]
    rings = nodes.select("node", "weak", F.explode(F.expr(f"array({', '.join(each)})")).alias("ring")).select("node", "weak", "ring.at", "ring.next", "ring.k")
    bits = f"transform(sequence(0, {UNCERTAIN - 1}), p -> shiftleft(1L, ascii(substring(weak, k * {UNCERTAIN} + p + 1, 1)) - 65))"
    sets = ", ".join(" | ".join(f"w[{i}]" for i in c) or "0L" for c in SETS)
    sets = rings.select("node", "at", "next", F.expr(bits).alias("w")).select("node", "at", "next", F.explode(F.expr(f"array({sets})")).alias("set"))
    return sets.select(F.expr("at ^ set").alias("entry"), "node", F.expr(f"shiftleft(set, {WIDTH}) | next").alias("turned"))


def parts(tau: int) -> list[tuple[int, int, int]]:
    """``(at, width, radius)``: parts of the 128 bits such that fingerprints within ``tau`` bits differ in at most ``radius`` bits of one of them.

    If each part had more, they would differ in the sum of radius + 1 = tau + 1 bits.  Parts that
    need not be looked at (radius -1) are left out.
    """
    n = max(LEAST_PARTS, tau // 3 + 1)
    radius, more = divmod(tau - n + 1, n)
    ends = [128 * k // n for k in range(n + 1)]
    each = [(ends[k], ends[k + 1] - ends[k], radius + (k < more)) for k in range(n)]
    return [p for p in each if p[2] >= 0]


def _part(x: np.ndarray, at: int, width: int) -> np.ndarray:
    """The part's bits of fingerprints given as two rows, their halves."""
    low, end = np.uint64((1 << width) - 1), at + width
    if end <= 64:
        return (x[0] >> np.uint64(64 - end)) & low
    if at >= 64:
        return (x[1] >> np.uint64(128 - end)) & low
    return ((x[0] << np.uint64(end - 64)) | (x[1] >> np.uint64(128 - end))) & low


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def _product(a: np.ndarray, b: np.ndarray, tau: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in ``a`` and in ``b`` of fingerprints within ``tau`` bits: by comparing all."""
    rows = max(1, CHUNK // 16 // max(1, b.shape[1]))
    for at in range(0, a.shape[1], rows):
        i, j = np.nonzero(np.bitwise_count(a[0, at : at + rows, None] ^ b[0]) <= tau)
        i += at
        near = _distance(a[0, i], b[0, j]) + _distance(a[1, i], b[1, j]) <= tau
        yield i[near], j[near]


def _probed(a: np.ndarray, b: np.ndarray, tau: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As :func:`_product`, each pair once: where a part is within its radius all values are looked up that far from it."""
    split = parts(tau)
    for nth, (at, width, radius) in enumerate(split):
        of_a, of_b = (_part(x, at, width).astype(np.int32) for x in (a, b))
        in_a, in_b = np.argsort(of_a), np.argsort(of_b)
        start = np.zeros((1 << width) + 1, np.int32)
        np.cumsum(np.bincount(of_b, minlength=1 << width), out=start[1:])
        sorted_a, first, second = of_a[in_a], int(at + width <= 64), int(at + width > 64)
        xa, xb = a[:, in_a], b[:, in_b]
        for turned in itertools.chain.from_iterable(itertools.combinations(range(width), n) for n in range(radius + 1)):
            key = sorted_a ^ np.int32(sum(1 << t for t in turned))
            begin = start[key]
            count = start[key + 1] - begin
            some = np.flatnonzero(count)
            begin, count = begin[some], count[some]
            until = np.cumsum(count, dtype=np.int64)
            # so many of the rows at a time as have about CHUNK candidates
            cuts = np.searchsorted(until, np.arange(CHUNK, until[-1] + CHUNK, CHUNK)) if len(some) else []
            low = 0
            for high in np.unique(np.minimum(np.asarray(cuts, np.int64) + 1, len(some))):
                n = count[low:high]
                i = np.repeat(some[low:high], n)
                j = np.repeat(begin[low:high] - (until[low:high] - n), n) + np.arange(until[low] - n[0], until[high - 1])
                low = high
                # the half without the part tells more
                near = np.flatnonzero(np.bitwise_count(xa[first][i] ^ xb[first][j]) <= tau)
                i, j = i[near], j[near]
                near = _distance(xa[0, i], xb[0, j]) + _distance(xa[1, i], xb[1, j]) <= tau
                i, j = in_a[i[near]], in_b[j[near]]
                for at_, width_, radius_ in split[:nth]:
                    new = np.bitwise_count(_part(a[:, i], at_, width_) ^ _part(b[:, j], at_, width_)) > radius_
                    i, j = i[new], j[new]
                if len(i):
                    yield i, j


def _probing_pays(a: np.ndarray, b: np.ndarray, tau: int) -> bool:
    """Whether looking up is cheaper than comparing all; how many candidates meet is estimated on some pairs."""
    split, n = parts(tau), min(a.shape[1], b.shape[1], 4_096)
    if not n or max((width for _, width, _ in split), default=0) > MOST_WIDTH:
        return False
    lookups = sum(math.comb(width, k) for _, width, radius in split for k in range(radius + 1))
    x, y = a[:, :n], b[:, :n][:, ::-1]
    meet = sum((np.bitwise_count(_part(x, at, width) ^ _part(y, at, width)) <= radius).mean() for at, width, radius in split)
    return a.shape[1] * lookups * NS_LOOKUP < a.shape[1] * b.shape[1] * (NS_COMPARED - meet * NS_CANDIDATE)


def close(a: np.ndarray, b: np.ndarray, tau: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all fingerprints of ``a`` and ``b`` (rows of halves) within ``tau`` bits, each pair once."""
    return (_probed if _probing_pays(a, b, tau) else _product)(a, b, tau)


def similar_pairs(nodes: DataFrame, tau: int = TAU) -> DataFrame:
    """``(a, b)``, a < b: all nodes ``(node, hi, lo)`` whose fingerprints differ in at most ``tau`` bits."""
    nodes = nodes.where("hi IS NOT NULL").select("node", "hi", "lo")
    n = nodes.count()
    blocks = max(1, -(-n // BLOCK_ROWS), min(BLOCKS, -(-n // SMALL_BLOCK)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        both, block = rows.column("both")[0].as_py(), rows.column("block").to_numpy()
        sides = []
        for at in divmod(both, blocks):
            some = rows.filter(pa.array(block == at))
            sides.append((some.column("node").combine_chunks(), np.stack([some.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo")])))
        (ids_a, a), (ids_b, b) = sides
        for i, j in close(a, b, tau):
            if both % (blocks + 1) == 0:  # a block with itself
                i, j = i[i < j], j[i < j]
            for at in range(0, len(i), CHUNK):
                yield pa.RecordBatch.from_arrays([ids_a.take(pa.array(i[at : at + CHUNK])), ids_b.take(pa.array(j[at : at + CHUNK]))], names=["a", "b"])

    kind = nodes.schema["node"].dataType.simpleString()
    dealt = nodes.withColumn("block", F.expr(f"cast(pmod(xxhash64(hi, lo), {blocks}) as int)"))
    dealt = dealt.withColumn("both", F.expr(f"explode(transform(sequence(0, {blocks - 1}), o -> least(o, block) * {blocks} + greatest(o, block)))"))
    met = dealt.repartition(blocks * (blocks + 1) // 2, "both").groupBy("both").applyInArrow(run, f"a {kind}, b {kind}")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)``: for each node of ``edges`` ``(a, b)`` the least node it is connected with.

    Rounds of large and small stars (Kiveris et al., 2014) until no edge changes.
    """
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v")
        edges = checkpointed(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now


def near_duplicates(docs: DataFrame, tau: int = TAU, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, group_id, n_links, keep)`` for each row of ``docs``.

    ``group_id`` is the least id of the group, which alone has ``keep``; a document without
    near-duplicates is its own group.  ``n_links`` counts the other fingerprints within ``tau``
    bits (copies have the same one and aren't expanded into pairs).  Null texts and texts without
    words are never grouped and have no links.
    Rows with a null id are kept, ungrouped.  Rows that repeat an id are one document: ``keep``
    is true for one of them at most.
    """
    with text_batches(docs.sparkSession):
        prints = checkpointed(fingerprints(docs, id_col, text_col, probes=False).withColumnRenamed(id_col, "__id"))
    known = prints.where("hi IS NOT NULL AND __id IS NOT NULL")
    nodes = checkpointed(known.groupBy("hi", "lo").agg(F.min("__id").alias("node")))
    pairs = checkpointed(similar_pairs(nodes, tau))
    roots = components(pairs)
    links = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    named = nodes.join(roots, "node", "left").join(links, "node", "left").select("hi", "lo", F.coalesce("root", "node").alias("group_id"), "n_links")
    known = F.col("__id").isNotNull()
    grouped = prints.join(named, ["hi", "lo"], "left").select("__id", "hi", "lo", F.when(known, F.coalesce("group_id", "__id")).alias("group_id"), F.coalesce(F.when(known, F.col("n_links")), F.lit(0)).alias("n_links"))
    # By id; rows without one are spread over groups of their own.
    first = F.row_number().over(Window.partitionBy("__id", F.when(F.col("__id").isNull(), F.xxhash64("hi", "lo"))).orderBy("group_id", "hi", "lo"))
    own = F.col("__id").isNull() | ((F.col("__id") == F.col("group_id")) & (F.col("nth") == 1))
    return grouped.withColumn("nth", first).select(F.col("__id").alias(id_col), "group_id", "n_links", own.alias("keep"))


def one_of_each(docs: DataFrame, tau: int = TAU, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of :func:`near_duplicates`, with all its columns.

    The ids to drop are joined; texts are shuffled only if there are too many ids to broadcast.
    Of rows that repeat an id, the one with the least text stays (just these are compared).
    """
    decided = checkpointed(near_duplicates(docs, tau, id_col, text_col))
    at = F.col(f"`{id_col}`")
    by_id = decided.where(at.isNotNull()).groupBy(at.alias("__dropped")).agg(F.max("keep").alias("__kept"), F.count("*").alias("__n"))
    drop, repeated = checkpointed(by_id.where("NOT __kept").select("__dropped")), checkpointed(by_id.where("__kept AND __n > 1").select("__dropped"))
    some = repeated.count()
    drop, repeated = (F.broadcast(x) if n <= MAX_BROADCAST_IDS else x for x, n in ((drop, drop.count()), (repeated, some)))
    kept = docs.join(drop, docs[f"`{id_col}`"] == drop["__dropped"], "left_anti")
    if not some:
        return kept
    nth = fresh(docs, "nth")
    once = kept.join(repeated, kept[f"`{id_col}`"] == repeated["__dropped"], "left_semi")
    once = once.withColumn(nth, F.row_number().over(Window.partitionBy(at).orderBy(F.col(f"`{text_col}`").asc_nulls_last()))).where(f"{nth} = 1").drop(nth)
    return kept.join(repeated, kept[f"`{id_col}`"] == repeated["__dropped"], "left_anti").unionByName(once)


#: So many ids (some 40 MB) are broadcast; more are joined by shuffle.
MAX_BROADCAST_IDS = 1_000_000
