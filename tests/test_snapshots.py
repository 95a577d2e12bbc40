import pytest
from pyspark.sql import functions as F

from corvane.plans import indexing, search
from corvane.sources import markdown
from corvane.sources.snapshots import Snapshots
from corvane.streaming import usage

NOTES = {
    "a.md": "# Alpha\n\nAlpha Project notes on search engines by John Smith. See [[Beta]] #project\n",
    "sub/beta.md": "---\ntitle: Beta\ntags: [x]\n---\n# Beta\n\nJohn Smith wrote about ranking and search. #project #ranking\n",
    "empty.md": "  \n",
    "c.txt": "not markdown",
}


@pytest.fixture
def folder(tmp_path):
    for name, text in NOTES.items():
        p = tmp_path / "notes" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return tmp_path


def test_commits_and_rollback(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "s"))
    assert s.version == 0 and s.tables() == []
    df = spark.range(5)
    assert s.commit({"t": df, "u": df}) == 1
    s.update("t", lambda old: old.where("id < 3"))
    assert s.version == 2 and s.read("t").count() == 3 and s.read("u").count() == 5 and s.get("t", "id", 2).count() == 1
    with pytest.raises(Exception):
        s.update("t", lambda old: old.select(F.raise_error(F.lit("stop")).alias("id")))
    assert s.version == 2 and s.read("t").count() == 3
    s.clear("t")
    assert s.read("t").count() == 0
    with pytest.raises(KeyError):
        s.read("none")


def test_index_search_and_incremental(spark, folder):
    root, store = str(folder / "notes"), Snapshots(spark, str(folder / "store"))
    assert [r["path"] for r in markdown.files(spark, root).orderBy("path").collect()] == ["a.md", "sub/beta.md"]
    assert indexing.index_folder(spark, root, store) == {"added": 2, "modified": 0, "deleted": 0, "unchanged": 0}
    nodes, edges = store.read("nodes"), store.read("edges")
    assert {r["title"] for r in nodes.where("type = 'note'").collect()} == {"A", "Beta"}
    assert {r["id"] for r in nodes.where("type = 'tag'").collect()} == {"tag_project", "tag_ranking"}
    assert nodes.where("title = 'John Smith'").count() == 1 and edges.where("type = 'references'").count() == 1
    stores = search.Stores(store.read("chunks"), nodes, edges, store.read("documents"), store.read("document_tags"))
    top = search.vector_search(stores, "search engines", 5, 0.0).orderBy("rank").collect()
    assert top[0]["file_path"] == "a.md" and len({r["file_path"] for r in top}) == len(top)
    got = search.unified(stores, "search", 5, 0.0).orderBy("rank").collect()
    assert got and got[0]["rank"] == 1
    assert search.query_documents(stores, any_tag=["ranking"]).select("filename", "tags").first().asDict() == {"filename": "sub/beta.md", "tags": ["project", "ranking", "x"]}
    for bad in ("", " ", "x" * 1001):
        with pytest.raises(ValueError):
            search.vector_search(stores, bad)
    (folder / "notes" / "a.md").unlink()
    (folder / "notes" / "d.md").write_text("# Delta\n\nA new note by John Smith. #ranking\n")
    assert indexing.index_folder(spark, root, store) == {"added": 1, "modified": 0, "deleted": 1, "unchanged": 1}
    assert {r[0] for r in store.read("chunks").select("file_path").collect()} == {"sub/beta.md", "d.md"}
    assert {r[0] for r in store.read("provenance").select("path").collect()} == {"sub/beta.md", "d.md"}


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = usage.daily_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "60 days")
    q = stream.writeStream.format("memory").queryName("daily").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("daily").collect())) == sorted(map(tuple, usage.daily_counts(events).collect()))
    assert usage.once(events.union(events)).count() == events.count() and usage.sessions(events).count() > 0 and usage.sliding_counts(events).count() > 0


def test_command_line(spark, folder):
    from corvane import cli

    do = lambda *a: cli.run(spark, cli.parser().parse_args([*a, "--store", str(folder / "cli")]))
    assert do("index", str(folder / "notes"))["added"] == 2
    assert do("status")["version"] == 1 and do("health")["dangling_edges"] == 0
    assert do("search", "search engines", "--threshold", "0")[0]["rank"] == 1
    assert [r["filename"] for r in do("query", "--tag", "ranking")] == ["sub/beta.md"]
