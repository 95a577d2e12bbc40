"""Operator 6: best-fit packing into bins of several permitted lengths.

Items are documents' token lengths; a document longer than the largest length is cut into
pieces of that length and a rest.  Items are taken by falling length.  Each goes into the open
bin with the least room that still holds it; if none does, a bin is opened of the length that
costs least per token it is going to hold, given the smaller items still to come.  At the end
each bin is downsized to the least permitted length that holds its contents.

All items of one length are alike, so the algorithm runs on the number of items by length:
one grouped aggregation, whose result has no more rows than the largest length has tokens,
whatever the corpus.  Its plan says which ranks of each length go to which bins; the documents
then look their bins up by their rank within their length.  So the packing is that of the
whole corpus at once, and nothing but ids and lengths is shuffled.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import bpe
from corvane.llm.common import checkpointed, pick, text_batches
from corvane.session import spread

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: What a bin costs besides its length, in tokens (the step's fixed part).
OVERHEAD = 32
#: A length's items are ranked in cells of about so many, each in one task; a hot length has many cells.
CELL_ROWS = 1_000_000
#: Nor has a cell many more tokens than this, since rows may carry them.
CELL_TOKENS = 4_000_000
#: So many rows at once leave a Python worker, so that long token lists don't pile up.
SLICE_ROWS = 500


def cost(capacity: int, overhead: int = OVERHEAD) -> int:
    return capacity + overhead


def _opened(length: int, pending: int, smaller: int, capacities: Sequence[int], overhead: int) -> int:
    """The length of bin to open: the least cost per token held.

    A bin holds as many of the pending items of this length as fit; the room left over is
    filled by smaller items as far as there are any.  Ties go to the larger bin.
    """
    best, at = None, capacities[-1]
    for c in reversed(capacities):
        if c < length:
            break
        alike = min(pending, c // length) * length
        rate = cost(c, overhead) / (alike + min(c - alike, smaller))
        if best is None or rate < best:
            best, at = rate, c
    return at


def plan(counts: dict[int, int], capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray]:
    """The packing of ``counts`` (items by length).

    Returns runs and bins.  A run ``(length, first rank, items, first bin, items a bin, offset)``
    puts the items of that length from that rank on into consecutive bins, so many in each, the
    first of them at the offset.  Bins come as ranges ``(first bin, number, capacity, used)``
    with the downsized capacity.
    """
    capacities = sorted(capacities)
    room: dict[int, list[tuple[int, int, int]]] = {}  # by room left: (first bin, number, opened length)
    rooms: list[int] = []
    runs, bins, after = [], 0, sum(k * n for k, n in counts.items())

    def put(left: int, group: tuple[int, int, int]) -> None:
        if left not in room:
            room[left] = []
            bisect.insort(rooms, left)
        bisect.insort(room[left], group)

    for length in sorted(counts, reverse=True):
        n, rank = counts[length], 0
        after -= length * n
        while rank < n:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                c = _opened(length, n - rank, after, capacities, overhead)
                each = c // length
                # as many bins as the rest of this length fills, the last of them perhaps in part
                more = max(1, (n - rank) // each)
                put(c, (bins, more, c))
                bins += more
                continue
            left = rooms[at]
            first, number, c = room[left].pop(0)
            each, rest = left // length, n - rank
            whole = min(number, rest // each)
            if whole:
                runs.append((length, rank, whole * each, first, each, c - left))
                rank += whole * each
                put(left - each * length, (first, whole, c))
                if whole < number:
                    put(left, (first + whole, number - whole, c))
            else:  # the last few items share one bin
                runs.append((length, rank, rest, first, rest, c - left))
                rank = n
                put(left - rest * length, (first, 1, c))
                if number > 1:
                    put(left, (first + 1, number - 1, c))
            if not room[left]:
                del room[left]
                rooms.remove(left)
    ranges = []
    for left, groups in room.items():
        for first, number, c in groups:
            if c - left:
                ranges.append((first, number, next(x for x in capacities if x >= c - left), c - left))
    return np.array(runs, np.int64).reshape(-1, 6), np.array(sorted(ranges), np.int64).reshape(-1, 4)


def pack_lengths(items: DataFrame, capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD, cell_rows: int = CELL_ROWS, id_bytes: int = 4) -> DataFrame:
    """Packs ``items`` ``(id, length)`` and returns ``(id, piece, n_pieces, length, bin, capacity, offset)``.

    ``piece`` counts from 0 within a row of ``items``.  Rows with a null or non-positive length
    hold nothing and have one row with null bin.  Repeated rows are packed as often as they
    occur.  Bins are numbered from 0; ``capacity`` is the downsized one.  A third column of ``items``,
    their token ids as little-endian integers of ``id_bytes`` (2 or 4), is cut along and comes as ``token_ids``.
    """
    capacities = sorted(capacities)
    top = capacities[-1]
    id_col, *more = [c for c in items.columns if c != "length"]
    n_pieces = F.greatest(F.lit(1), F.ceil(F.col("length") / top)).cast("int")
    pieces = items.select(F.col(f"`{id_col}`"), F.coalesce(F.greatest(F.col("length"), F.lit(0)), F.lit(0)).cast("long").alias("length"), *[F.col(f"`{c}`").alias("tokens") for c in more])
    held_along = ["tokens"] if more else []
    pieces = pieces.select(f"`{id_col}`", F.col("length").alias("total"), n_pieces.alias("n_pieces"), *held_along, F.explode(F.sequence(F.lit(0), n_pieces - 1)).alias("piece"))
    cut = [F.substring(F.col("tokens"), F.col("piece") * top * id_bytes + 1, F.lit(top * id_bytes)).alias("tokens") for _ in held_along]
    pieces = pieces.select(f"`{id_col}`", "piece", "n_pieces", F.least(F.lit(top), F.col("total") - F.col("piece").cast("long") * top).cast("int").alias("length"), *cut)
    with text_batches(items.sparkSession):
        pieces = checkpointed(pieces)
    some = pieces.where("length > 0")
    # At most one row for each length up to the largest, and one more for so many items or tokens: all that the driver sees of the corpus.
    sizes = some.groupBy("length").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("salts", F.greatest(F.ceil(F.col("n") / cell_rows), F.ceil(F.col("n") * F.col("length") / CELL_TOKENS)).cast("int"))
    sizes = checkpointed(sizes)
    held = sizes.toPandas()
    if (held["salts"] > 1).any():
        salted = pieces.join(F.broadcast(sizes.where("salts > 1").select("length", "salts")), "length", "left")
        salted = salted.withColumn("salt", F.pmod(F.xxhash64(f"`{id_col}`", "piece"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
        held = salted.where("length > 0").groupBy("length", "salt").agg(F.count("*").alias("n")).toPandas()
    else:  # each length is one cell, so the rows needn't be read again to count them
        salted, held = pieces.withColumn("salt", F.lit(0)), held.assign(salt=0)
    held = held.sort_values(["length", "salt"], ignore_index=True)
    held["first"] = held.groupby("length")["n"].cumsum() - held["n"]
    runs, ranges = plan({int(k): int(v) for k, v in held.groupby("length")["n"].sum().items()}, capacities, overhead)
    order = np.lexsort((runs[:, 1], runs[:, 0]))
    tables = (held["length"].to_numpy(np.int64) << 32 | held["salt"].to_numpy(np.int64), held["first"].to_numpy(np.int64), runs[order], ranges)
    sent = items.sparkSession.sparkContext.broadcast(tables)
    salted = salted.select(f"`{id_col}`", "piece", "n_pieces", "length", "salt", *held_along)
    in_order = salted.repartition("length", "salt").sortWithinPartitions("length", "salt", f"`{id_col}`", "piece")
    names = [id_col, "piece", "n_pieces", "length", "bin", "capacity", "offset", *(["token_ids"] if more else [])]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, firsts, runs, ranges = sent.value
        wide = np.int64(1) << 40
        starts = runs[:, 0] * wide + runs[:, 1]
        cell, seen = None, 0  # the cell that the last rows were of, and how many of it there were
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                col = dict(zip(part.schema.names, part.columns))
                length, salt = (col[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "salt"))
                key = length << 32 | salt
                start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                within = np.arange(len(key)) - np.repeat(start, np.diff(np.r_[start, len(key)]))
                if key[0] == cell:
                    within[: start[1] if len(start) > 1 else len(key)] += seen
                cell, seen = key[-1], within[-1] + 1
                bin_, capacity, offset = (np.full(len(key), -1, np.int64) for _ in range(3))
                some = np.flatnonzero(length > 0)
                if len(some):
                    rank = firsts[np.searchsorted(keys, key[some])] + within[some]
                    r = runs[np.searchsorted(starts, length[some] * wide + rank, side="right") - 1]
                    nth = rank - r[:, 1]
                    bin_[some] = r[:, 3] + nth // r[:, 4]
                    offset[some] = r[:, 5] + nth % r[:, 4] * r[:, 0]
                    capacity[some] = ranges[np.searchsorted(ranges[:, 0], bin_[some], side="right") - 1, 2]
                out = [part.column(0), *(col[c] for c in ("piece", "n_pieces", "length")), *(pa.array(v, pa.int64(), mask=v < 0) for v in (bin_, capacity, offset))]
                yield pa.RecordBatch.from_arrays(out + ([_as_ids(col["tokens"], id_bytes)] if more else []), names=names)

    kind = items.schema[id_col].dataType.simpleString()
    ids = ", token_ids array<int>" if more else ""
    return in_order.mapInArrow(assign, f"`{id_col}` {kind}, piece int, n_pieces int, length int, bin long, capacity long, offset long{ids}")


def _as_ids(tokens: pa.Array, id_bytes: int = 4) -> pa.Array:
    """Little-endian integers of 4 bytes in a binary column as lists, without copying them, or of 2 bytes; nulls are empty."""
    tokens = tokens.fill_null(b"") if tokens.null_count else tokens
    ends = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset : tokens.offset + len(tokens) + 1]
    data = tokens.buffers()[2]
    if id_bytes == 2:
        ids = np.frombuffer(data if data is not None else b"", "<u2", (int(ends[-1]) - int(ends[0])) // 2, int(ends[0])).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array((ends - ends[0]) // 2, pa.int32()), pa.array(ids))
    values = pa.Array.from_buffers(pa.int32(), int(ends[-1]) // 4, [None, data if data is not None else pa.py_buffer(b"")])
    return pa.ListArray.from_arrays(pa.array(ends // 4, pa.int32()), values)


def pack_documents(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD, vocabulary: str = bpe.DEFAULT_VOCABULARY, id_col: str = "doc_id", text_col: str = "text", tokens: bool = False) -> DataFrame:
    """:func:`pack_lengths` of the documents' token counts; null and empty texts hold nothing.

    With ``tokens`` each piece carries its ``token_ids``, so that a bin's pieces by offset are a
    training sequence; pieces without tokens have an empty list.
    """
    docs = spread(pick(docs, id_col, text_col))
    if tokens:
        # ids that fit 2 bytes travel in them, which halves what is written, shuffled, sorted and held in batches
        wide = bpe.id_bytes(bpe.read_vocabulary(vocabulary))
        return pack_lengths(bpe.quick_tokens(docs, vocabulary, id_col, text_col, wide), capacities, overhead, id_bytes=wide)
    items = docs.select(docs[f"`{id_col}`"].alias(id_col), bpe.count_column(docs, text_col, vocabulary).alias("length"))
    return pack_lengths(items, capacities, overhead)
