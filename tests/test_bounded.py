"""Steps whose memory or work has to stay bounded as tables grow, against plain ones."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane import catalogue
from corvane.functions import chunking
from corvane.functions import text as tx
from corvane.operators import analyzers, graph, keyword


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_python_stems_distinct_tokens_only(spark, sf):
    rows = spark.createDataFrame([(["running", "dogs", "running"],), (None,), ([],), (["x", "ponies"],)], "t array<string>")
    assert [r[0] for r in rows.select(tx.stemmed(F.col("t"))).collect()] == [["run", "dog", "run"], None, [], ["x", "poni"]]
    docs = spark.createDataFrame([(1, ["dogs", "dog", "cat"]), (2, ["cats"]), (3, None)], "doc_id int, toks array<string>")
    posted = keyword.stemmed_postings(docs, spark.createDataFrame([(1, "dog"), (2, "cat"), (2, "x")], "query_id int, term string"))
    assert sorted(map(tuple, posted.collect())) == [(1, "cat", 1), (1, "dog", 2), (2, "cat", 1)] and "EvalPython" not in plan(posted)


def test_texts_are_cut_into_terms_once(spark):
    chunks = spark.createDataFrame([("a1", "The Cafés of the sea of\u0300 the", "x/of.md"), ("a2", "of-the_of the", "of/the.md"), ("a3", None, "the.md"), ("", "", ""), ("a4", "cafe of  the", "y.md")], "doc_id string, content string, file_path string")
    stored = keyword.postings(chunks)
    for query in ("of-the cafe", "the", "of", "nothing the", "of-the-of", "md"):
        got = keyword.bm25_texts(chunks, query)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, keyword.bm25_indexed(stored, chunks, query).collect())) and "MapInArrow" not in plan(got)
    plain = {}
    for r in chunks.collect():
        at = 0
        for text in r:
            for t in keyword.terms(text):
                plain.setdefault((r[0], t), []).append(at)
                at += 1
            at += 1
    assert {(r["doc_id"], r["term"]): r["positions"] for r in stored.collect()} == plain


def test_files_are_held_a_hundred_at_once():
    text = "# T\n\n## A\n" + "word " * 120 + "\n## B\n" + "other " * 60
    batch = pa.record_batch({"path": [f"p{i}" for i in range(250)], "content": [text] * 249 + [None]})
    got = list(chunking.chunk_batches(iter([batch]), chunking.by_headers))
    assert [b.num_rows for b in got] == [200, 200, 98] and got[2].column(0)[97].as_py() == "p248::chunk_1"


def test_only_common_words_are_counted_by_note(spark):
    rnd = random.Random(2)
    notes = [(i, " ".join(f"word{'abcdefgh'[min(7, int(rnd.expovariate(0.5)))]}" for _ in range(rnd.randrange(12)))) for i in range(60)]
    got = analyzers.frequent_words(spark.createDataFrame(notes, "id int, content string"), top=4)
    count = lambda w: sum(t.split().count(w) for _, t in notes)
    common = sorted({w for _, t in notes for w in t.split()}, key=lambda w: (-count(w), w))[:4]
    held = [(w, i) for w in common for i, t in notes if t.split().count(w) >= 2]
    assert sorted(map(tuple, got.collect())) == sorted(x for x in held if sum(w == x[0] for w, _ in held) >= 2) and held
    assert "Aggregate [id" in plan(got) and all("Join" in x for x in plan(got).split("Aggregate [id")[1:])


def test_trees_over_places_are_those_of_a_queue(spark):
    np = pytest.importorskip("numpy")
    rnd = random.Random(8)
    near = {i: set() for i in range(80)}
    for _ in range(110):
        a, b = rnd.sample(range(80), 2)
        near[a].add(b), near[b].add(a)
    lists = [sorted(near[i]) for i in range(80)]
    starts, flat = np.cumsum([0, *map(len, lists)]).astype(np.int32), np.array(sum(lists, []), np.int32)
    total, mark, first, want = np.zeros(80, np.int64), np.full(80, -1, np.int32), np.zeros(80, np.int32), [0] * 80
    for root in range(0, 80, 3):
        graph._add_tree(root, starts, flat, total, mark, first)
        parent, queue = {root: None}, [root]
        for x in queue:
            for y in lists[x]:
                if y not in parent:
                    parent[y] = x
                    queue.append(y)
        for x in queue[1:]:
            x = parent[x]
            while x is not None and x != root:
                want[x] += 1
                x = parent[x]
    assert total.tolist() == want
