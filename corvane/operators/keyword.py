"""Keyword operators: tokens, postings and BM25 with AND semantics and phrases (RT9, RT10, AG13, §2.9.1)."""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import porter, stemmed
from corvane.session import checkpointed, spread

K1, B = 1.2, 0.75
#: The distinct terms of a batch of queries are broadcast up to this number.
MAX_BROADCAST_TERMS = 1_000_000
_TOKEN = re.compile(r"[^\W_]+")
#: Characters that a query word loses.
STRIPPED = "\"'\\(){}[]*^:~@#$%&|<>!"


def tokens(text: Column) -> Column:
    """Small-letter runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def folded(text: str | None) -> str:
    """Small letters without diacritics."""
    low = (text or "").lower()
    if low.isascii():
        return low
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", low) if not unicodedata.combining(c)))


def terms(text: str | None) -> list[str]:
    """A text's tokens as the index holds them: folded runs of letters and digits, stemmed."""
    return [stem(t) for t in _TOKEN.findall(folded(text))]


@functools.lru_cache(maxsize=200_000)
def stem(token: str) -> str:
    return porter(token)


#: The columns that a search looks through; a phrase doesn't go on from one to the next.
SEARCHED = ("doc_id", "content", "file_path")


def postings(chunks: DataFrame, key: str = "doc_id", columns: tuple[str, ...] = SEARCHED) -> DataFrame:
    """``(key, term, tf, positions, dl)`` of each chunk and term, over all ``columns`` together.

    Terms are folded Porter stems; ``dl`` is the chunk's number of tokens.  A chunk's postings are
    made where the chunk is, so nothing is shuffled.  A chunk without tokens has none.
    """
    names = [key, "term", "tf", "positions", "dl"]
    kind = chunks.schema[key].dataType.simpleString()
    rows = chunks.select(F.col(key).alias("__key"), *[F.col(c).cast("string").alias(f"__{i}") for i, c in enumerate(columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                row, place, code, words, length = _placed(part.columns[1:])
                order = np.lexsort((place, code, row))
                row, place, code = row[order], place[order], code[order]
                new = np.flatnonzero(np.diff(row, prepend=-1) | np.diff(code, prepend=-1))
                ends = np.append(new, len(row)).astype(np.int32)
                out = [part.column(0).take(pa.array(row[new])), words.take(pa.array(code[new])), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends), pa.array(place)), pa.array(length[row[new]])]
                yield pa.RecordBatch.from_arrays(out, names=names)

    return spread(rows).mapInArrow(run, f"`{key}` {kind}, term string, tf int, positions array<int>, dl int")


#: Texts that are cut into terms together.
ROWS_AT_ONCE = 500


def _placed(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Every token of some rows: its row, its place there and its term as a code, the codes' terms, and the rows' numbers of tokens.

    Terms are those of :func:`terms`, found for each distinct token once.  A place is left free
    between columns, so that no phrase crosses them.
    """
    rows = len(columns[0])
    dl, at = np.zeros(rows, np.int32), np.zeros(rows, np.int32)
    row, place, token = [], [], []
    for c in columns:
        low = [folded(t) for t in c.to_pylist()]
        held = [_TOKEN.findall(t) for t in low]
        n = np.fromiter(map(len, held), np.int32, rows)
        row.append(np.repeat(np.arange(rows), n))
        place.append(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - at, n))
        token += itertools.chain.from_iterable(held)
        dl += n
        at += n + 1
    encoded = pa.array(token, pa.string()).dictionary_encode()
    stems = pa.array([stem(t) for t in encoded.dictionary.to_pylist()], pa.string()).dictionary_encode()
    code = stems.indices.to_numpy()[encoded.indices.to_numpy()] if len(token) else np.zeros(0, np.int32)
    return np.concatenate(row), np.concatenate(place).astype(np.int32), code, stems.dictionary, dl


def search_terms(query: str) -> list[list[str]]:
    """A query's words as the index holds them, each as the terms of a phrase."""
    return [[t for w in phrase for t in terms(w)] for phrase in query_words(query)]


def bm25_indexed(posted: DataFrame, chunks: DataFrame, query: str, key: str = "doc_id") -> DataFrame:
    """RT9 over :func:`postings`: ``(key, score)`` of the chunks that hold every word (or phrase) of a query.

    Only the postings of the query's terms are read (the table is sorted by term), and the corpus's
    number of chunks and of tokens, which come as one row.
    """
    words = [w for w in search_terms(query) if w]
    wanted = sorted({t for w in words for t in w})
    hits = posted.where(F.col("term").isin(wanted))
    held = hits.groupBy(key).agg(F.max("dl").alias("dl"), *[F.max(F.when(F.col("term") == t, F.col("positions"))).alias(f"p{i}") for i, t in enumerate(wanted)])
    places = {t: F.coalesce(F.col(f"p{i}"), F.array().cast("array<int>")) for i, t in enumerate(wanted)}

    def count(phrase: list[str]) -> Column:
        if len(phrase) == 1:
            return F.size(places[phrase[0]])
        return F.size(F.filter(places[phrase[0]], lambda p: reduce(lambda a, b: a & b, [F.array_contains(places[t], p + F.lit(i)) for i, t in enumerate(phrase) if i])))

    counted = held.select(key, "dl", *[count(w).alias(f"tf{i}") for i, w in enumerate(words)])
    corpus = chunks.agg(F.count("*").alias("n")).crossJoin(posted.agg(F.sum("tf").alias("tokens"))).select("n", (F.col("tokens") / F.col("n")).alias("avgdl"))
    seen = counted.agg(*[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words))])
    return _scored(counted, corpus.crossJoin(seen), len(words), key)


def bm25_texts(chunks: DataFrame, query: str, key: str = "doc_id", columns: tuple[str, ...] = SEARCHED) -> DataFrame:
    """:func:`bm25_indexed` where no postings are stored: texts are cut into terms once, and only counts leave Python."""
    words = [w for w in search_terms(query) if w]
    kind = chunks.schema[key].dataType.simpleString()
    rows = chunks.select(F.col(key).alias("__key"), *[F.col(c).cast("string").alias(f"__{i}") for i, c in enumerate(columns)])
    names = [key, "dl", *[f"tf{i}" for i in range(len(words))]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                row, place, code, held, length = _placed(part.columns[1:])
                order = np.lexsort((place, row))
                row, place, code = row[order], place[order], code[order]
                of = {t: i for i, t in enumerate(held.to_pylist())}
                counts = []
                for phrase in words:
                    hit = np.flatnonzero(code == of.get(phrase[0], -1))
                    for i, t in enumerate(phrase):
                        hit = hit[hit + i < len(code)]
                        hit = hit[(code[hit + i] == of.get(t, -1)) & (row[hit + i] == row[hit]) & (place[hit + i] == place[hit] + i)]
                    counts.append(pa.array(np.bincount(row[hit], minlength=part.num_rows).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(length), *counts], names=names)

    counted = checkpointed(spread(rows).mapInArrow(run, f"`{key}` {kind}, dl int" + "".join(f", tf{i} int" for i in range(len(words)))))
    totals = counted.agg(F.count("*").alias("n"), (F.sum("dl") / F.count("*")).alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words))])
    return _scored(counted, totals, len(words), key)


def document_frequency(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(term, df, cf)``: in how many documents a term occurs, and how often."""
    return spread(docs.select(key, text)).select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").count().groupBy("term").agg(F.count("*").alias("df"), F.sum("count").alias("cf"))


def query_words(query: str) -> list[list[str]]:
    """A query's words, each as the tokens of a phrase: characters that search syntax uses go, and hyphens at the edges."""
    out = []
    for w in query.split():
        w = "".join(c for c in w if c not in STRIPPED).strip("-")
        phrase = [t for t in re.split(r"[^\w]+|_", w.lower()) if t]
        if phrase:
            out.append(phrase)
    return out


_EDGE_BEFORE, _EDGE_AFTER, _GAP = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])", r"[^\p{L}\p{N}]+"


def _phrase_count(lowered: Column, phrase: list[str]) -> Column:
    """How often the tokens of a phrase follow each other in a text in small letters.

    Counted by a pattern, so that no array of tokens is made, and only where the words occur at all;
    only the first word is consumed, so overlapping occurrences all count.
    """
    words = [re.escape(w) for w in phrase]
    rest = "".join(f"{_GAP}{w}" for w in words[1:])
    pattern = f"{_EDGE_BEFORE}{words[0]}(?={rest}{_EDGE_AFTER})"
    there = reduce(lambda a, b: a & b, [F.contains(lowered, F.lit(w)) for w in phrase])
    return F.when(there, F.regexp_count(lowered, F.lit(pattern))).otherwise(0)


def bm25(docs: DataFrame, words: list[list[str]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """RT9: ``(key, score)`` of the documents that hold every word (or phrase); larger is better.

    One pass counts, one more scores; document counts and the mean length come as a single row
    that is joined back, so no posting is shuffled.  Null texts count as empty ones.
    """
    rows = spread(docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("t")))
    low = F.lower("t")
    counted = rows.select(key, F.regexp_count("t", F.lit(r"[\p{L}\p{N}]+")).alias("dl"), *[_phrase_count(low, w).alias(f"tf{i}") for i, w in enumerate(words)])
    totals = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words))])
    return _scored(counted, totals, len(words), key)


def _scored(counted: DataFrame, totals: DataFrame, words: int, key: str) -> DataFrame:
    """Scores from ``(key, dl, tf0, ...)`` and one row ``(n, avgdl, df0, ...)``."""
    score = F.lit(0.0)
    for i in range(words):
        idf = F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
        tf = F.col(f"tf{i}")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    every = reduce(lambda a, b: a & b, [F.col(f"tf{i}") > 0 for i in range(words)], F.lit(bool(words)))
    return counted.where(every).crossJoin(F.broadcast(totals)).select(key, F.round(score, 6).alias("score"))


def bm25_from_postings(posted: DataFrame, lengths: DataFrame, queries: DataFrame, key: str = "doc_id", limit: int = 10) -> DataFrame:
    """RT9 for many queries over stored postings: ``(query_id, key, score, rank)``.

    ``queries`` has ``(query_id, term)``; a document has to hold all of a query's distinct terms.
    """
    wanted = queries.select("query_id", "term").distinct()
    need = wanted.groupBy("query_id").agg(F.count("*").alias("need"))
    posted = posted.join(F.broadcast(wanted.select("term").distinct()) if wanted.count() <= MAX_BROADCAST_TERMS else wanted.select("term").distinct(), "term", "left_semi")
    df = posted.groupBy("term").agg(F.count("*").alias("df"))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    hits = posted.join(wanted, "term").join(df, "term").join(lengths, key).crossJoin(F.broadcast(stats))
    part = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = hits.groupBy("query_id", key).agg(F.round(F.sum(part), 6).alias("score"), F.count("*").alias("have")).join(need, "query_id").where("have = need")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", key, "score", "rank")


def stemmed_postings(docs: DataFrame, queries: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, term, tf)`` of the stems that ``queries`` ``(query_id, term)`` ask for, from documents ``(key, toks)``.

    Python sees the corpus's distinct tokens, not its texts.
    """
    each = docs.select(key, F.explode("toks").alias("token"))
    stems = each.select("token").distinct().select("token", F.element_at(stemmed(F.array("token")), 1).alias("term"))
    wanted = queries.select("term").distinct()
    known = checkpointed(stems.join(wanted, "term", "left_semi"))
    return each.join(F.broadcast(known) if known.count() <= MAX_BROADCAST_TERMS else known, "token").groupBy(key, "term").agg(F.count("*").alias("tf"))


def normalised_rank(rank: Column) -> Column:
    """RT10: a (negative) keyword rank as a score in [0, 1]; 0.1 where there is none."""
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 + rank / 50)), F.lit(0.1))
