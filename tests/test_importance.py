import random

from corvane.operators import graph


def test_same_importance_beyond_the_broadcast_bound(spark, monkeypatch):
    rnd = random.Random(3)
    pairs = {(f"n{rnd.randrange(60)}", f"n{rnd.randrange(60)}") for _ in range(75)} | {("x", "y"), ("y", "z"), ("z", "w")}
    edges = spark.createDataFrame([(f"{a}-{b}", a, b) for a, b in sorted(pairs)], "id string, source_id string, target_id string")
    scores = lambda n: {r["id"]: r["importance"] for r in graph.importance(edges, n).collect()}
    broadcast = [scores(n) for n in (7, 500)]
    monkeypatch.setattr(graph, "MAX_BROADCAST_EDGES", 0)
    assert [scores(n) for n in (7, 500)] == broadcast and any(graph.importance(edges.limit(0)).collect()) is False
