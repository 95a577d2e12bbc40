"""Index and searches against plain Python: stemmed keywords, joins by blocks, vector cells, builds and updates."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane import catalogue
from corvane.functions import chunking
from corvane.functions import text as tx
from corvane.functions.embedding import hashed
from corvane.operators import analyzers, graph, incremental, keyword, ranking, vector
from corvane.plans import indexing, search
from corvane.sources.snapshots import Snapshots


# ---- keywords


def slow_bm25(rows, query):
    """``rows`` are ``(key, texts)``; scores of those that hold every word or phrase of the query in some column."""
    words = keyword.search_terms(query)
    columns = {k: [keyword.terms(t) for t in texts] for k, texts in rows}
    lengths = {k: sum(map(len, cols)) for k, cols in columns.items()}
    average = sum(lengths.values()) / len(rows)
    tf = {k: [sum(cols[c][i : i + len(w)] == w for c in range(len(cols)) for i in range(len(cols[c]))) for w in words] for k, cols in columns.items()}
    df = [sum(1 for v in tf.values() if v[i]) for i in range(len(words))]
    out = {}
    for k, v in tf.items():
        if not all(v):
            continue
        score = 0.0
        for n, d in zip(v, df):
            idf = math.log((len(rows) - d + 0.5) / (d + 0.5))
            score += (idf if idf > 0 else 1e-6) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * lengths[k] / average))
        out[k] = round(score, 6)
    return out


def test_indexed_bm25_against_plain_python(spark):
    rnd = random.Random(3)
    vocabulary = "run running runner café cafe Résumé resume state-of the art of fox foxes 42".split()
    rows = [(f"n{i}/x.md::chunk_{i}", " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 25))), f"n{i}/{rnd.choice(vocabulary)}.md") for i in range(60)] + [("null", None, None), ("empty", "", "")]
    chunks = spark.createDataFrame(rows, "doc_id string, content string, file_path string")
    posted = keyword.postings(chunks).cache()
    for query in ("running", "CAFE", "foxes 42", "state-of", "art-of the", "md run", "nothing here", "chunk_3"):
        got = {r["doc_id"]: r["score"] for r in keyword.bm25_indexed(posted, chunks, query).collect()}
        want = slow_bm25([(r[0], r) for r in rows], query)
        assert got == pytest.approx(want, abs=2e-6), query
    assert {r["doc_id"] for r in keyword.bm25_indexed(posted, chunks, "run").collect()} == {r["doc_id"] for r in keyword.bm25_indexed(posted, chunks, "running").collect()}


def test_stemmed_batch_query(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    split = lambda t: [tx.porter(w) for w in __import__("regex").findall(r"[\p{L}\p{N}]+", t.lower())]
    toks = {k: split(t) for k, t in docs.items()}
    average = sum(map(len, toks.values())) / len(toks)
    df = {}
    for t in toks.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    want = set()
    for q in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        words = set(split(q["text"]))
        scored = []
        for k, t in toks.items():
            if words <= set(t):
                idf = lambda d: (lambda x: x if x > 0 else 1e-6)(math.log((len(toks) - d + 0.5) / (d + 0.5)))
                scored.append((-round(sum(idf(df[w]) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / average)) for w in words), 4), k))
        want |= {(q["item_id"], k, rank) for rank, (_, k) in enumerate(sorted(scored)[:10], 1)}
    assert {(r["query_id"], r["doc_id"], r["rank"]) for r in catalogue.QUERIES["bm25_stemmed"](spark, sf).collect()} == want


def test_columns_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = slow_bm25([(r["doc_id"], (str(r["doc_id"]), r["text"], f"docs/{r['source']}/{r['lang']}.md")) for r in docs], "Docs of-the EN")
    got = {r["doc_id"]: r["score"] for r in catalogue.QUERIES["bm25_columns"](spark, sf).collect()}
    assert got == pytest.approx(want, abs=2e-6) and got


def test_phrases_that_overlap_all_count(spark):
    docs = spark.createDataFrame([(1, "a a a b"), (2, "A-a. x"), (3, "aa a"), (4, None)], "doc_id long, text string")
    rows = {r["doc_id"] for r in keyword.bm25(docs, [["a", "a"]]).collect()}
    assert rows == {1, 2}
    low = docs.select("doc_id", keyword._phrase_count(F.lower("text"), ["a", "a"]).alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in low if r["n"]} == {1: 2, 2: 1}


# ---- joins


def test_containment_against_all_pairs(spark):
    rnd = random.Random(4)
    make = lambda: "".join(rnd.choice("abc é") for _ in range(rnd.randrange(1, 9)))
    parts, wholes = sorted({make() for _ in range(120)}), sorted({make() for _ in range(120)})
    got = {tuple(r) for r in analyzers.contained(spark.createDataFrame([(x,) for x in parts], "part string"), spark.createDataFrame([(x,) for x in wholes], "whole string")).collect()}
    assert got == {(p, w) for p in parts for w in wholes if p in w} and got


def test_numbered_is_the_window(spark):
    rows = spark.range(5000).select(F.col("id"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("x")).repartition(7)
    got = {r["id"]: r["rank"] for r in ranking.numbered(rows, F.desc("x"), "id").collect()}
    want = {r["id"]: r["n"] for r in rows.withColumn("n", F.row_number().over(Window.orderBy(F.desc("x"), "id"))).collect()}
    assert got == want and ranking.numbered(rows.limit(0), "id").collect() == []


def test_greedy_pruning_one_edge_at_a_time(spark, sf):
    rnd = random.Random(5)
    edges = [(f"e{i:03d}", rnd.choice("abcdef"), rnd.choice("ghijk"), rnd.choice((0.1, 0.3, 0.5, 0.9))) for i in range(120)]
    kept, n = set(), {}
    for i, s, t, w in sorted(edges, key=lambda e: (-e[3], e[0])):
        if w >= 0.3 and n.get(s, 0) < 4 and n.get(t, 0) < 4:
            kept.add(i)
            n[s], n[t] = n.get(s, 0) + 1, n.get(t, 0) + 1
    df = spark.createDataFrame(edges, "id string, source_id string, target_id string, weight double").repartition(5)
    assert {r["id"] for r in graph.prune_greedy(df, cap=4).collect()} == kept
    all_ = {r["id"]: r for r in catalogue._graph(spark, sf)[1].collect()}
    got = {r["id"] for r in catalogue.QUERIES["prune_greedy_cap"](spark, sf).collect()}
    n, want = {}, set()
    for r in sorted(all_.values(), key=lambda r: (-r["weight"], r["id"])):
        if r["weight"] >= 0.3 and n.get(r["source_id"], 0) < 50 and n.get(r["target_id"], 0) < 50:
            want.add(r["id"])
            n[r["source_id"]], n[r["target_id"]] = n.get(r["source_id"], 0) + 1, n.get(r["target_id"], 0) + 1
    assert got == want


# ---- vectors


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.RandomState(0)
    centres = rng.normal(0, 1, (6, 16))
    rows = [(i, (centres[i % 6] + rng.normal(0, 0.4, 16)).tolist()) for i in range(600)]
    return rows + [(600, [0.0] * 16), (601, None), (602, rows[3][1])]


def test_similar_pairs_miss_nothing(spark, clustered):
    df = spark.createDataFrame(clustered, "vec_id long, embedding array<double>")
    ids = [i for i, v in clustered if v is not None and any(v)]
    x = np.array([v for i, v in clustered if v is not None and any(v)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 6)
    for threshold in (0.95, 0.8):
        want = {(ids[i], ids[j]) for i in range(len(ids)) for j in range(i + 1, len(ids)) if s[i, j] >= threshold}
        for block in (4096, 40):
            assert {(r["a"], r["b"]) for r in vector.similar_pairs(df, threshold, block=block).collect()} == want
        changed = spark.createDataFrame([(3,), (602,), (17,)], "vec_id long")
        got = [(r["a"], r["b"]) for r in vector.similar_pairs(df, threshold, changed=changed, block=40).collect()]
        assert len(got) == len(set(got)) and set(got) == {p for p in want if set(p) & {3, 602, 17}}
    assert vector.similar_pairs(df.limit(0), 0.5).collect() == []


def test_dealt_batches_are_the_broadcast_ones(spark, clustered):
    df = spark.createDataFrame(clustered, "vec_id long, embedding array<double>")
    asked = df.select(F.col("vec_id").alias("query_id"), "embedding")
    one, many = (sorted(map(tuple, vector.search_batch(df, asked, 3, query_block=n).collect())) for n in (20_000, 100))
    assert one == many and len(one) == 3 * 602
    x = {i: np.array(v) for i, v in clustered if v is not None}
    for q in (0, 5, 600):
        near = sorted(((-round(float(x[q] @ v), 6), i) for i, v in x.items()))[:3]
        assert [(r[1], r[2]) for r in one if r[0] == q] == [(i, pytest.approx(-s)) for s, i in sorted(near, key=lambda p: p[1])]


def test_index_recall(spark):
    """All rows whose id is divisible by 50 as queries, against all rows, over written cells."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    index, centres = vector.build_index(df)
    index = index.cache()
    assert index.count() == df.where("embedding IS NOT NULL").count()
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in df.collect()}
    ids = np.array(sorted(rows))
    x = np.array([rows[i] for i in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    held = {r["vec_id"]: r["cell"] for r in index.select("vec_id", "cell").collect()}
    cells = np.array([held[i] for i in ids])
    found = wanted = 0
    for q in ids[ids % 50 == 0]:
        s = np.round(x @ x[np.searchsorted(ids, q)], 6)
        near = set(ids[np.lexsort((ids, -s))][:10])
        probed = np.argsort(-(centres @ x[np.searchsorted(ids, q)]), kind="stable")[:32]
        some = np.isin(cells, probed)
        found += len(near & set(ids[some][np.lexsort((ids[some], -s[some]))][:10]))
        wanted += 10
    assert found / wanted >= 0.9
    q = int(ids[0])
    got = [r["vec_id"] for r in vector.search_index(index, centres, rows[q], 5, probes=32).collect()]
    assert got[0] == q and len(got) == 5


# ---- searches


def test_vector_search_recomputed(spark, sf):
    stores = catalogue._page_stores(spark, sf)
    pages = {r["doc_id"]: r for r in stores.chunks.collect()}
    ids = sorted(pages)
    x = np.array([pages[i]["embedding"] for i in ids], np.float64)
    fused, best = {}, {}
    query = "thble42 ther"
    for n, v in enumerate(hashed(search.simple_variants(query))):
        s = np.round(x @ v, 6)
        for rank, j in enumerate(sorted(range(len(ids)), key=lambda j: (-s[j], ids[j]))[:10], 1):
            if s[j] < 0:
                continue
            fused[ids[j]] = fused.get(ids[j], 0) + 1 / (60 + rank)
            best[ids[j]] = max(best.get(ids[j], -1), float(s[j]))
    lexical = lambda t: 1 / (1 + math.exp(-(4 * sum(w in t.lower() for w in query.split()) / 2 - 2)))
    excerpt = lambda t: t if len(t) <= 2000 else t[:1000].rstrip(" ") + "\n...\n" + t[-1000:].lstrip(" ")
    rerank = {i: lexical(excerpt(pages[i]["content"])) for i in fused}
    score = {i: round(0.6 * best[i] + 0.15 / (1 + math.exp(-rerank[i])) + 0.25 * min(30 * round(fused[i], 4), 1), 4) for i in fused}
    got = catalogue.QUERIES["vector_search_page"](spark, sf).orderBy("rank").collect()
    assert [r["rank"] for r in got] == [1, 2, 3, 4, 5] and len({r["file_path"] for r in got}) == 5
    for r in got:
        assert r["similarity"] == pytest.approx(best[r["doc_id"]]) and r["rerank"] == pytest.approx(rerank[r["doc_id"]]) and r["score"] == pytest.approx(score[r["doc_id"]], abs=1e-4)
    assert [r["score"] for r in got] == sorted((r["score"] for r in got), reverse=True)
    least = sorted((rerank[i] for i in fused), reverse=True)[4]
    assert all(r["rerank"] >= least - 1e-9 for r in got)


def test_unified_has_all_layers_and_hooks(spark, sf):
    got = catalogue.QUERIES["unified_search"](spark, sf).collect()
    assert 0 < len(got) <= 5 and {r["mode"] for r in got} == {"vector+keyword+metadata+graph"} and {r["source"] for r in got} <= {"vector", "keyword", "metadata", "graph"}
    assert len({r["doc_id"] for r in got}) == len(got) and any(r["related"] for r in got)
    stores = catalogue._page_stores(spark, sf)
    flipped = search.vector_search(stores, "then ther", 3, 0.0, reranker=lambda q, c: F.length(c) / 1e6).collect()
    assert all(r["rerank"] == pytest.approx(len(r["content"]) / 1e6) for r in flipped)
    assert all(r["rerank"] is None for r in search.vector_search(stores, "then ther", 3, 0.0, reranker=None).collect())


def test_registered_acronyms_reach_the_workers(spark):
    tx.register_acronyms({"ZZQ": "zebra zone quest"})
    try:
        rows = tx.variants_frame(spark.createDataFrame([(1, "zzq"), (2, None)], "k long, q string"), "k", "q").collect()
    finally:
        del tx.ACRONYMS["zzq"]
    assert "zebra zone quest" in {r["variant"] for r in rows} and {r["k"] for r in rows} == {1}


# ---- builds


NOTES = {
    "a.md": "---\nstatus: draft\nproject: Moon\ncustom: 7\n---\n# Alpha\n\nAlpha Project notes on running engines by John Smith. See [[Beta]] #project\n",
    "sub/beta.md": "---\ntags: [X, ' y ']\ndate: 2024-01-05\n---\n# Beta\n\nJohn Smith wrote about ranking and search. #project #ranking\n",
    "c.md": "# Gamma\n\nA café by Jane Roe and John Smith.\n",
}


def write(root, notes):
    for name, text in notes.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)


def rows_of(store, table, *columns):
    return sorted((tuple(r) for r in store.read(table).select(*columns).collect()), key=str)


def test_updates_end_as_full_builds(spark, tmp_path):
    root = tmp_path / "notes"
    write(root, NOTES)
    store, whole = Snapshots(spark, str(tmp_path / "s")), Snapshots(spark, str(tmp_path / "w"))
    indexing.index_folder(spark, str(root), store, semantic=True, topics=False)
    version = store.version
    assert indexing.index_folder(spark, str(root), store, semantic=True, topics=False)["unchanged"] == 3 and store.version == version
    before = {r["doc_id"]: r["embedding"] for r in store.read("chunks").collect()}
    (root / "c.md").write_text("# Gamma\n\nNow about [[Alpha]] and searches by Ann Lee. #new\n")
    (root / "d.md").write_text("# Delta\n\nAnn Lee again, running.\n")
    (root / "sub/beta.md").unlink()
    assert indexing.index_folder(spark, str(root), store, semantic=True, topics=False) == {"added": 1, "modified": 1, "deleted": 1, "unchanged": 1}
    indexing.index_folder(spark, str(root), whole, semantic=True, topics=False)
    for table, columns in {"chunks": ("doc_id", "content"), "postings": ("doc_id", "term", "tf", "dl"), "nodes": ("id", "type", "title", "importance"), "edges": ("id", "source_id", "target_id", "type", "weight"), "documents": ("filename", "title", "status", "project"), "document_tags": ("filename", "tag"), "cross_refs": ("filename", "ref_type", "ref_target"), "provenance": ("path", "content_hash", "node_count", "edge_count")}.items():
        assert rows_of(store, table, *columns) == rows_of(whole, table, *columns), table
    assert {r["doc_id"]: r["embedding"] for r in store.read("chunks").where("file_path = 'a.md'").collect()} == {k: v for k, v in before.items() if k.startswith("a.md")}


def test_front_matter_is_searchable(spark, tmp_path):
    write(tmp_path / "notes", NOTES)
    store = Snapshots(spark, str(tmp_path / "s"))
    indexing.index_folder(spark, str(tmp_path / "notes"), store)
    docs = {r["filename"]: r for r in store.read("documents").collect()}
    assert docs["a.md"]["status"] == "draft" and docs["a.md"]["project"] == "Moon" and docs["a.md"]["meta"] == {"custom": "7"} and docs["c.md"]["status"] == "active"
    assert docs["sub/beta.md"]["created_date"] == "2024-01-05"
    assert rows_of(store, "document_tags", "filename", "tag") == [("a.md", "project"), ("sub/beta.md", "project"), ("sub/beta.md", "ranking"), ("sub/beta.md", "x"), ("sub/beta.md", "y")]
    assert rows_of(store, "cross_refs", "filename", "ref_type", "ref_target") == [("a.md", "wiki_link", "Beta")]
    stores = search.Stores.of(store)
    assert [r["filename"] for r in search.query_documents(stores, status="draft").collect()] == ["a.md"]
    assert "a.md" in {r["doc_id"] for r in search.unified(stores, "runs", 5, 0.0, filters={"status": "draft"}).collect()}
    assert "c.md" in {r["doc_id"] for r in search.unified(stores, "cafe", 5, 0.0).collect()}
    nodes = store.read("nodes")
    assert nodes.where("importance > 0").count() > 0 and {"note", "tag", "entity"} <= {r["type"] for r in nodes.select("type").distinct().collect()}
    now = [0.0]
    check = incremental.Consistency(store, ttl=10, clock=lambda: now[0])
    assert check.status()["cached"] is False and check.check()["consistent"] is True and check.status()["cached"] is True
    now[0] = 11.0
    assert check.status()["expired"] is True and check.check(force=True)["vectors"] == store.read("chunks").count()
    check.invalidate()
    assert check.status()["consistent"] is None
    assert incremental.consistency(store.read("chunks"), dimensions=3).first()["consistent"] is False


def test_chunks_are_checked_before_they_are_put(spark):
    held = indexing.upsert_chunks(spark.createDataFrame([], "doc_id string, content string, embedding array<float>"), spark.createDataFrame([("a", "old"), ("b", "stays")], "doc_id string, content string"))
    held = held.cache()
    new = spark.createDataFrame([("a", "new", [3.0] + [0.0] * 63), ("c", "more", None)], "doc_id string, content string, embedding array<double>")
    got = {r["doc_id"]: r for r in indexing.upsert_chunks(held, new).collect()}
    assert set(got) == {"a", "b", "c"} and got["a"]["content"] == "new" and got["a"]["embedding"][0] == 1.0 and len(got["c"]["embedding"]) == 64
    for rows in ([(" ", "x", None)], [("x", "", None)], [("x", None, None)], [("x", "y", [1.0])], [("x", "y", [1.0] * 64), ("z", "y", [1.0] * 3)]):
        with pytest.raises(ValueError):
            indexing.upsert_chunks(held, spark.createDataFrame(rows, "doc_id string, content string, embedding array<double>"), dimensions=64)


def test_headers_above_go_before_embedding(spark):
    cases = {"# T\n\n## P\n\n### S\nbody\n# not": "### S\nbody\n# not", "## S\nbody": "## S\nbody", "body\n# x": "body\n# x", "": "", "\n # a\nb ": "# a\nb", "# a\n## b": "## b"}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", tx.without_parents(F.col("t")).alias("x")).collect()
    assert {r["t"]: r["x"] for r in got} == cases


def test_keys_fall_back(spark):
    lists = spark.createDataFrame([(0, 1, None, "f1"), (0, 2, "d", "f2"), (1, 1, "d", "f2")], "list_no int, rank int, doc_id string, file string")
    assert {r["doc_id"] for r in ranking.reciprocal_rank_fusion(lists, fallback=F.col("file")).collect()} == {"d", "f1"}


def test_another_entity_extractor(spark, tmp_path):
    write(tmp_path / "notes", NOTES)
    from corvane.sources.markdown import files

    nodes, _ = indexing.build_graph(files(spark, str(tmp_path / "notes")), min_frequency=1, extractor=lambda notes: notes.select("id", F.lit("Thing").alias("entity")))
    assert {r["title"] for r in nodes.where("type = 'entity'").collect()} == {"Thing"}


def test_a_commit_that_fails_at_the_end_changes_nothing(spark, tmp_path, monkeypatch):
    s = Snapshots(spark, str(tmp_path / "s"))
    s.commit({"t": spark.range(3), "rare": spark.range(1)})
    other = Snapshots(spark, str(tmp_path / "s"))
    monkeypatch.setattr(other, "_pointer", lambda held=other._pointer(): held)
    s.commit({"t": spark.range(4)})
    with pytest.raises(OSError):
        other.commit({"t": spark.range(9)})
    assert s.version == 2
    for n in range(5, 9):
        s.commit({"t": spark.range(n)})
    assert s.read("t").count() == 8 and s.read("rare").count() == 1
    assert len(list((tmp_path / "s" / "t").glob("v*"))) == 3 and len(list((tmp_path / "s").glob("CURRENT.*"))) == 3


def test_chunk_queries_are_the_chunkers(spark, sf):
    rows = catalogue._markdown(spark, sf).collect()
    want = {(f"{r['path']}::chunk_{i}", c.section, c.content_hash, c.part_number, c.total_parts) for r in rows for i, c in enumerate(chunking.hybrid(r["content"], r["path"]))}
    assert {tuple(r) for r in catalogue.QUERIES["hybrid_chunks"](spark, sf).collect()} == want
    for r in rows:  # nothing of a section is lost
        parts = " ".join(c.content.split("---\n", 1)[-1] for c in chunking.hybrid(r["content"], r["path"]))
        assert all(s in parts for s in chunking.split_sentences(r["content"].split("\n", 3)[-1])[:-1][:50])
    got = {r["item_id"]: [] for r in catalogue.QUERIES["query_variants_full"](spark, sf).collect()}
    assert got and catalogue.QUERIES["query_variants_full"](spark, sf).where("n = 0").count() == len(got)


def test_topics_are_the_same_twice(spark, sf):
    one, two = (sorted(map(tuple, catalogue.QUERIES["topic_kmeans"](spark, sf).collect())) for _ in range(2))
    assert one == two and one and all(t.startswith("topic_") for _, t in one)
