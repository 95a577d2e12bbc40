import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import analyzers, graph, incremental, keyword, metadata, ranking, vector


def lists(spark, *ranked):
    rows = [(n, r, d, s) for n, items in enumerate(ranked) for r, (d, s) in enumerate(items, 1)]
    return spark.createDataFrame(rows, "list_no int, rank int, doc_id string, similarity double")


def fused(df, **kw):
    return [tuple(r) for r in ranking.reciprocal_rank_fusion(df, **kw).orderBy("rank").collect()]


def test_rrf(spark):
    assert fused(lists(spark, [], [])) == []
    assert fused(lists(spark, [("d1", None)]))[0][1] == round(1 / 61, 4)
    assert [x[0] for x in fused(lists(spark, [("d1", None), ("d2", None), ("d3", None)], [("d3", None), ("d1", None)]))] == ["d1", "d3", "d2"]
    got = fused(lists(spark, [("d1", 0.9), ("d2", 0.8)], [("d2", 0.85), ("d3", 0.7)]), similarity="similarity")
    assert got[0][0] == "d2" and got[0][3] == 0.85 and len(got) == 3
    assert fused(lists(spark, [("a", 0.7)], [("a", 0.9)], [("a", 0.8)]), similarity="similarity")[0][3] == 0.9
    for k in (0, 1001, 60.5, "60", True):
        with pytest.raises(ValueError):
            ranking.reciprocal_rank_fusion(lists(spark, []), k=k)


def test_rrf_truncates(spark):
    big = lists(spark, *[[(f"{n}-{i}", None) for i in range(101)] for n in range(10)])
    assert len(fused(big)) == 1000


def test_dedupe_and_excerpt(spark):
    rows = spark.createDataFrame([(1, "a/x.md"), (2, "b/x.md"), (3, "s::c/y.md::chunk_1"), (4, "y.md"), (5, ""), (6, "")], "rank int, file_path string")
    assert [r[0] for r in ranking.dedupe_by_file(rows).orderBy("rank").select("rank").collect()] == [1, 3, 5, 6]
    assert ranking.dedupe_by_file(rows, key="path").count() == 6
    t = spark.createDataFrame([("a" * 3000,)], "x string").select(ranking.excerpt(F.col("x"))).first()[0]
    assert t == "a" * 1000 + "\n...\n" + "a" * 1000


def test_bm25_is_the_formula(spark):
    import math

    docs = spark.createDataFrame([(1, "red fox red"), (2, "red dog and cat"), (3, "blue fox"), (4, ""), (5, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in keyword.bm25(docs.where("text IS NOT NULL"), [["red"], ["fox"]]).collect()}
    n, avg = 4, (3 + 4 + 2 + 0) / 4
    idf = lambda d: max(math.log((n - d + 0.5) / (d + 0.5)), 1e-6) if math.log((n - d + 0.5) / (d + 0.5)) > 0 else 1e-6
    part = lambda tf, d: idf(d) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * 3 / avg))
    assert got == {1: pytest.approx(round(part(2, 2) + part(1, 2), 6))}
    assert [r[0] for r in keyword.bm25(docs.where("text IS NOT NULL"), [["red", "fox"]]).collect()] == [1]


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in vector.search(rows, [1.0, 0.0], 2).collect()] == [(1, 1.0), (2, 0.6)]
    assert [tuple(r) for r in vector.search(rows, [1.0, 0.0], 3, 0.5).collect()] == [(1, 1.0), (2, 0.6)]
    got = {(r["query_id"], r["vec_id"]) for r in vector.search_batch(rows, rows.select(F.col("vec_id").alias("query_id"), "embedding"), 1).collect()}
    assert {(1, 1), (2, 2), (3, 3)} <= got
    for block in (1, 2, 100):
        assert sorted(tuple(r) for r in vector.similar_pairs(rows, 0.5, block=block).collect()) == [(1, 2, 0.6), (2, 3, 0.8)]
    changed = rows.where("vec_id = 1").select("vec_id")
    assert [tuple(r) for r in vector.similar_pairs(rows, 0.5, changed=changed).collect()] == [(1, 2, 0.6)]


# ---- metadata


@pytest.fixture(scope="module")
def store(spark):
    docs = spark.createDataFrame(
        [("doc1", "Python Tutorial", "tutorial", "published", "learning", 4), ("doc2", "JavaScript Guide", "tutorial", "draft", "learning", 3), ("doc3", "Project Notes", "notes", "active", "work", 2), ("doc4", "Old Draft", "tutorial", "archived", "old", 1)],
        "filename string, title string, category string, status string, project string, updated_at int",
    )
    tags = spark.createDataFrame([("doc1", "python"), ("doc1", "programming"), ("doc2", "javascript"), ("doc2", "programming"), ("doc3", "notes"), ("doc3", "work")], "filename string, tag string")
    return docs, tags


def test_filters(store):
    docs, tags = store
    n = lambda **kw: metadata.filter_documents(docs, tags, **kw).count()
    assert (n(category="tutorial"), n(status="published"), n(project="learning"), n(any_tag=["Python", "work"]), n(any_tag=["programming"], status="draft", category="tutorial"), n(status="")) == (3, 1, 2, 2, 1, 4)
    assert [r["filename"] for r in metadata.title_search(docs, "a guide to python").collect()] == ["doc1", "doc2"]
    assert {r["filename"]: r["tags"] for r in metadata.with_tags(docs, tags).collect()}["doc4"] == []


def test_usage(spark):
    day = lambda d: dt.datetime(2024, 1, d)
    docs = spark.createDataFrame([("popular",), ("accessed",), ("rarely",), ("never",)], "filename string")
    events = [("popular", "search_hit")] * 10 + [("popular", "read")] * 5 + [("accessed", a) for a in ("search_hit", "read", "update")] + [("rarely", "read"), (None, "read")]
    usage = spark.createDataFrame([(f, a, day(1 + i % 5)) for i, (f, a) in enumerate(events)], "filename string, action string, ts timestamp")
    assert [r[0] for r in metadata.never_accessed(docs, usage).collect()] == ["never"]
    top = metadata.most_accessed(docs, usage).collect()
    assert [(r["filename"], r["total"], r["search_hit"], r["read"]) for r in top[:2]] == [("popular", 15, 10, 5), ("accessed", 3, 1, 1)]
    assert metadata.trend_summary(usage, 7, F.lit("2024-01-06").cast("timestamp"), ("read",)).first()["total"] == 20


def test_mutations(spark, store):
    docs, tags = store
    new = docs.where("filename = 'doc1'").withColumn("title", F.lit("New"))
    up = metadata.upsert(docs, new)
    assert up.count() == 4 and up.where("title = 'New'").count() == 1
    fresh = spark.createDataFrame([("doc1", " Rust "), ("doc1", "rust"), ("doc1", " ")], "filename string, tag string")
    assert sorted(r["tag"] for r in metadata.replace_tags(tags, fresh).where("filename = 'doc1'").collect()) == ["rust"]
    d, t = metadata.remove_documents(spark.createDataFrame([("doc1",)], "filename string"), docs, tags)
    assert d.count() == 3 and t.count() == 4
    assert metadata.remove_by_prefix(docs, "doc", "filename").count() == 0 and metadata.remove_by_prefix(docs, "d%", "filename").count() == 4


# ---- graph


def make(spark, edges, kinds=None):
    ids = sorted({x for e in edges for x in e[:2]})
    nodes = spark.createDataFrame([(i, (kinds or {}).get(i, "note"), i, None) for i in ids], "id string, type string, title string, source_file string")
    rows = [(f"{a}-{b}", a, b, "references", float(w), 1.0, None) for a, b, *r in edges for w in [r[0] if r else 0.5]]
    return nodes, spark.createDataFrame(rows, "id string, source_id string, target_id string, type string, weight double, confidence double, source_file string")


def test_neighbours_paths_hubs(spark):
    nodes, edges = make(spark, [("n1", "n2"), ("n2", "n3"), ("n1", "n4"), ("n2", "n5")])
    start = spark.createDataFrame([("n1",)], "start string")
    near = lambda d: {(r["node"], r["distance"]) for r in graph.neighbours(edges, start, d).collect()}
    assert near(1) == {("n2", 1), ("n4", 1)} and near(2) == near(1) | {("n3", 2), ("n5", 2)}
    assert graph.shortest_path(edges, "n4", "n3").first()["path"] == ["n4", "n1", "n2", "n3"]
    assert graph.shortest_path(edges, "n4", "nowhere").count() == 0 and graph.shortest_path(edges, "n4", "n4").first()["distance"] == 0
    assert graph.hub_nodes(nodes, edges, 1).first()["id"] == "n2"
    got = graph.connections(nodes, edges, "N1", 2).first()
    assert got["n"] == 4 and [c["node"] for c in got["connections"]][:2] == ["n2", "n4"]
    with pytest.raises(ValueError):
        graph.neighbours(edges, start, 4)


def test_importance(spark):
    score = lambda e: {r["id"]: r["importance"] for r in graph.importance(make(spark, e)[1]).collect()}
    s = score([("A", "B"), ("A", "C"), ("A", "D"), ("B", "C")])
    assert s["A"] == 1 and all(0 <= v <= 1 and v < s["A"] for k, v in s.items() if k != "A")
    s = score([("A", "B"), ("B", "C"), ("C", "D")])
    assert s["B"] > s["A"] and s["C"] > s["D"]
    assert graph.importance(make(spark, [("A", "B")])[1].limit(0)).count() == 0


def test_merge_prune_integrity(spark):
    nodes, edges = make(spark, [("a", "b", 0.9), ("c", "b", 0.2), ("c", "a", 0.5)])
    twins = nodes.withColumn("title", F.when(F.col("id") == "c", " A ").otherwise(F.col("title")))
    kept, moved = graph.merge_duplicates(twins, edges)
    assert sorted(r["id"] for r in kept.collect()) == ["a", "b"] and sorted(r["id"] for r in moved.collect()) == ["a-b", "references_a_b"]
    assert graph.weak_edges_removed(edges).count() == 2 and graph.prune_greedy(edges, 0.1, 1).count() == 1
    bad = edges.limit(1).withColumns({"id": F.lit("x"), "target_id": F.lit("gone")})
    with pytest.raises(ValueError):
        graph.add_edges(nodes, edges, bad)
    assert graph.add_edges(nodes, edges, bad, strict=False).count() == 3
    n, e = graph.remove_nodes(nodes, edges, spark.createDataFrame([("a",)], "id string"))
    assert n.count() == 2 and e.count() == 1


# ---- analyzers


def test_days_apart(spark):
    day = lambda d: dt.datetime(2024, 1, d)
    rows = lambda *ds: spark.createDataFrame([(f"n{i}", day(d)) for i, d in enumerate(ds)], "id string, ts timestamp")
    got = lambda df, w: sorted(r["days"] for r in analyzers.within_days(df, window=w).collect())
    assert got(rows(1, 4, 11), 7) == [3, 7] and got(rows(15, 17, 22), 5) == [2, 5] and got(rows(1, 3, 9), 10) == [2, 6, 8]
    e = {r["weight"] for r in analyzers.temporal(rows(1, 3, 9), 10).collect()}
    assert len(e) == 3 and all(0.3 <= w <= 1 for w in e)
    late = rows(1, 4, 11).where("id = 'n2'")
    assert analyzers.within_days(late, rows(1, 4, 11), 7).count() == 1
    assert analyzers.capped(analyzers.temporal(rows(1, 1, 1, 1), 1), 1).count() == 2


def test_days_apart_over_blocks(spark):
    """Pairs are those of a comparison of all with all, whatever the blocks; keys of two times and copies included."""
    rnd = random.Random(5)
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rnd.randrange(12 * 86400) // 7200 * 7200)
    old = [(i, at()) for i in range(150)] + [(7, at()), (9, at()), (None, at()), (151, None)]
    new = [old[7], old[9], old[20], (30, at()), (7, at()), (200, at())]
    frame = lambda rows: spark.createDataFrame(rows, "id long, ts timestamp")
    days = lambda x, y: int(abs((x[1] - y[1]).total_seconds()) // 86400)
    whole = lambda rows: [r for r in rows if None not in r]
    pair = lambda x, y: (*(z[0] for z in sorted((x, y), key=lambda r: (r[1], r[0]))), days(x, y))
    rows = whole(old)
    for block in (4, 1000):
        got = sorted(map(tuple, analyzers.within_days(frame(old), window=2, block=block).collect()))
        assert got == sorted(pair(x, y) for i, x in enumerate(rows) for y in rows[:i] if x[0] != y[0] and days(x, y) <= 2)
        got = sorted(map(tuple, analyzers.within_days(frame(new), frame(old), window=2, block=block).collect()))
        assert got == sorted({pair(x, y) for x in new for y in rows if x[0] != y[0] and days(x, y) <= 2})
    few = analyzers.within_days(frame(old))
    assert few.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism  # one file of few bytes was one task


def test_entities_links_topics(spark):
    notes = spark.createDataFrame([("note_a", "Alice", "we met Bob Stone and Alice Hill #x"), ("note_b", "Bob", "so Bob Stone met Charlie Ray [[alice]] #x #y")], "id string, title string, content string")
    nodes, edges = analyzers.entities(notes)
    names = {r["title"]: r["entity_type"] for r in nodes.collect()}
    assert names["Bob Stone"] == "person" and "Alice Hill" not in names and "Charlie Ray" not in names
    assert edges.where("type = 'mentions'").count() == 2 * len(names)
    assert [(r["source_id"], r["target_id"]) for r in analyzers.references(notes).collect()] == [("note_b", "note_a")]
    t, e = analyzers.tags(notes)
    assert sorted(r["id"] for r in t.collect()) == ["tag_x", "tag_y"] and e.count() == 3
    spans = spark.createDataFrame([("n", "A", 0, 5), ("n", "B", 20, 25), ("n", "C", 300, 305)], "note string, entity string, start int, end int")
    rel = spark.createDataFrame([("n", "uses", 18, 30, 0.9), ("n", "uses", 19, 26, 0.5)], "note string, type string, start int, end int, score double")
    assert [tuple(r) for r in analyzers.span_relations(spans, rel).collect()] == [("A", "B", "uses", 0.9)]


# ---- maintenance


def test_changes(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    old = spark.createDataFrame([("b", "2"), ("c", "x"), ("d", "4")], "path string, content_hash string")
    assert {r["path"]: r["status"] for r in incremental.changes(now, old).collect()} == {"a": "added", "b": "unchanged", "c": "modified", "d": "deleted"}


def test_incremental_update_drops_and_rebuilds(spark):
    from corvane.plans.indexing import build_graph

    files = spark.createDataFrame(
        [("a.md", "# A\n[[file_b]] #tag1", dt.datetime(2024, 1, 1)), ("file_b.md", "# B\n#tag2", dt.datetime(2024, 1, 2)), ("c.md", "#tag3", dt.datetime(2024, 1, 3))],
        "path string, content string, modified timestamp",
    ).withColumn("content", F.concat("content", F.lit("\n"), "path"))
    nodes, edges = (spark.createDataFrame(df.collect(), df.schema) for df in build_graph(files))
    known = incremental.provenance(files, nodes, edges)
    ids = lambda df: {r["id"] for r in df.collect()}
    assert {"tag_tag1", "tag_tag2", "tag_tag3"} <= ids(nodes)
    now = files.where("path <> 'c.md'").withColumn("content", F.when(F.col("path") == "file_b.md", "# B\n#tag9").otherwise(F.col("content")))
    n, e, found = incremental.update(now, nodes, edges, known, build_graph)
    assert {r["path"]: r["status"] for r in found.collect()} == {"a.md": "unchanged", "file_b.md": "modified", "c.md": "deleted"}
    assert {"tag_tag1", "tag_tag9"} <= ids(n) and not {"tag_tag2", "tag_tag3"} & ids(n)
    assert graph.integrity(n, e).count() == 0 and e.where("type = 'tagged_as'").count() == 2
    assert incremental.fill_abstracts(nodes.withColumn("l0_abstract", F.lit(None).cast("string")).limit(1), lambda c: F.substring(c, 1, 3)).first()["l0_abstract"]


def test_edge_and_node_filters(spark):
    nodes, edges = make(spark, [("a", "b"), ("b", "c")], {"b": "tag"})
    assert [graph.edges_of(edges, "b", d).count() for d in ("in", "out", "both")] == [1, 1, 2]
    assert graph.by_type(nodes.withColumn("created_at", F.lit(1)), "tag").count() == 1
