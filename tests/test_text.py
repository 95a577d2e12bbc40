import pytest
from pyspark.sql import functions as F

from corvane.functions import chunking
from corvane.functions import text as tx
from corvane.functions.embedding import embed_cached, hashed
from corvane.operators.keyword import query_words


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize("q,want", [("CS656", ["CS656", "cs656", "CS 656", "cs 656"]), ("CS 646", ["CS 646", "cs 646", "CS646", "cs646"]), ("jawz-search", ["jawz-search", "jawzsearch", "jawz search"]), ("", [])])
def test_variants_on_both_sides(spark, q, want):
    from corvane.plans.search import simple_variants

    assert one(spark, q, tx.query_variants) == want == simple_variants(q)


@pytest.mark.parametrize("q", ["CS656", "python3.12", "gym_routine", "D&D session", "tcp/ip", "2024-08-07", "what is ML", "how to train a neural network?", "ml", "machine learning"])
def test_all_variants(q):
    v = tx.all_query_variants(q)
    assert v[0] == q and len(v) == len(set(v)) <= tx.MAX_VARIANTS


def test_all_variants_expand():
    assert "machine learning" in tx.all_query_variants("ML") and "ml" in tx.all_query_variants("machine learning")
    assert "neural networks" in tx.all_query_variants("what are neural networks?") and "file name" in tx.all_query_variants("file_name")
    assert tx.all_query_variants(None) == [] and len(tx.ACRONYMS) == 44
    tx.register_acronyms({"XYZ": "extra yellow zebra"})
    assert "extra yellow zebra" in tx.all_query_variants("xyz")
    del tx.ACRONYMS["xyz"]


def test_tags_and_links(spark):
    text = "#First and #two-b not x#three ## Header #123\n#first [[Target]] [[Shown|Real one]] [[[no]]]"
    assert one(spark, text, tx.hashtags) == ["first", "two-b"]
    assert one(spark, text, tx.loose_hashtags) == ["first", "two", "three", "123"]
    assert one(spark, text, tx.wiki_links) == ["Target", "Real one"]
    assert one(spark, text, tx.loose_wiki_links)[:2] == ["Target", "Shown"]


def test_titles_are_like_pythons(spark):
    for p in ("a/o'reilly-3d_x foo2bar.md", "daily-log-2024-01-20.md", "ÉTÉ_là.md"):
        stem = p.split("/")[-1][:-3]
        assert one(spark, p, tx.title_from_filename) == stem.replace("-", " ").replace("_", " ").title()


@pytest.mark.parametrize("text,n", [("Dr. Smith went to St. Mary's hospital. He met Mr. Johnson there.", 2), ("The value is 3.14159. This is the next sentence.", 2), ("One two three.\n\nFour five six", 2), ("abc", 0), ("", 0)])
def test_sentences_on_both_sides(spark, text, n):
    assert len(one(spark, text, tx.sentences)) == n
    assert one(spark, text, tx.sentences) == chunking.split_sentences(text)


def test_porter():
    pairs = "caresses caress ponies poni cats cat feed feed agreed agre plastered plaster motoring motor conflated conflat hopping hop falling fall filing file happy happi sky sky relational relat conditional condit digitizer digit radically radic triplicate triplic hopeful hope goodness good revival reviv allowance allow inference infer adjustment adjust adoption adopt probate probat rate rate cease ceas controll control roll roll"
    words = pairs.split()
    assert [tx.porter(w) for w in words[::2]] == words[1::2]


def test_context_header(spark):
    row = spark.createDataFrame([("a/b.md", None, ["x", "y"], None, "draft")], "p string, t string, g array<string>, c string, s string")
    got = row.select(tx.context_header(*map(F.col, "ptgcs"))).first()[0]
    assert got == chunking.context_header("a/b.md", {"tags": ["x", "y"], "status": "draft"}) == "[Document: b]\n[Source: a/b.md]\n[Tags: x, y]\n[Category: draft]\n---"


def test_query_words():
    assert query_words('"hello" (wor-ld) **') == [["hello"], ["wor", "ld"]]


# ---- chunkers


def test_front_matter():
    front, body = chunking.front_matter("---\ntitle: T\ndate: 2024-01-02\ntags: [a, b]\n---\n# H\n")
    assert front == {"title": "T", "date": "2024-01-02", "tags": ["a", "b"]} and body == "# H\n"
    assert chunking.front_matter("---\n: : [\n---\nbody") == ({}, "body")
    assert chunking.front_matter("no front") == ({}, "no front")


def test_headers():
    filler = "Words that fill the section up. " * 20
    text = f"# Title\nlost\n## A\n{filler}\n### A1\n{filler}\n## B\nshort\n" + f"## C\n{'x' * 5000}"
    got = chunking.by_headers(text, "d/f.md")
    assert [(c.section, c.parent_header) for c in got] == [("A", "Title"), ("A1", "A"), ("B", "Title"), ("C", "Title")]
    assert "# Title\n## A\n\n### A1" in got[1].content and "lost" not in "".join(c.content for c in got)
    assert got[3].content.endswith("x" * 5000)
    cut = chunking.by_headers(text, "d/f.md", strict=True)
    assert cut[3].content.endswith("...") and len(cut[3].content.split("---\n", 1)[1]) == 4000
    words = " ".join(f"Sentence number {i} ends here." for i in range(600))
    assert "number 599 ends" in "".join(c.content for c in chunking.hybrid(f"# T\n## A\n{words}", "f.md"))
    assert [c.section for c in chunking.by_headers("## A\nsmall", "f.md")] == ["full_document"]
    assert [c.section for c in chunking.by_headers(filler, "f.md")] == ["no_headers"]
    assert chunking.by_headers(None) == chunking.by_headers("  ") == []


def test_boundaries():
    assert chunking.boundaries([0.9, 0.8, 0.2, 0.7]) == [0, 3, 5] and chunking.boundaries([]) == []
    assert chunking.boundaries([0.9, 0.9, 0.1], "stddev", 1.0) == [0, 3, 4]
    with pytest.raises(ValueError):
        chunking.boundaries([0.5], "other")


def test_merging_and_splitting():
    assert chunking.merge_small(["a", "bbbb", "cccc", "d"], 3) == ["a bbbb", "cccc", "d"]
    s = ["First one.", "Second one.", "Third one."]
    assert chunking.split_large([" ".join(s)], 22, s) == ["First one. Second one.", "Third one."] or chunking.split_large([" ".join(s)], 22, s) == s[:0] + ["First one. Second one.", "Third one."]
    assert chunking.split_large(["zzzz"], 2, []) == ["zz..."]


def test_hybrid_covers_its_section(spark):
    sentences = [f"Sentence number {i} speaks of {'cats' if i < 20 else 'engines'} only." for i in range(60)]
    text = "# T\n## Long\n" + " ".join(sentences) + "\n## Short\n" + "Nothing much here at all."
    got = chunking.hybrid(text, "f.md")
    long = [c for c in got if c.parent_section == "Long"]
    assert len(long) > 1 and [c.part_number for c in long] == list(range(1, len(long) + 1)) and long[0].section == "Long (part 1)"
    assert all(any(s in c.content for c in long) for s in sentences)
    assert [c.section for c in chunking.hybrid(text, "f.md", embed=None)] == ["Long", "Short"]
    files = spark.createDataFrame([("f.md", text), ("e.md", "")], "path string, content string")
    rows = chunking.chunk_files(files, source_name="s").collect()
    assert [r["doc_id"] for r in rows] == [f"s::f.md::chunk_{i}" for i in range(len(got))] and [r["content"] for r in rows] == [c.content for c in got]


def test_embeddings_are_cached(spark):
    calls = spark.sparkContext.accumulator(0)

    def embed(texts):
        calls.add(len(texts))
        return hashed(texts)

    rows = spark.createDataFrame([("a", "x y"), ("b", "x y"), ("c", "z")], "id string, content string")
    out, cache = embed_cached(rows, None, embed=embed)
    assert out.count() == 3 and cache.count() == 2
    cache = spark.createDataFrame(cache.collect(), cache.schema)
    before = calls.value
    again, more = embed_cached(rows, cache, embed=embed)
    assert again.where("embedding IS NULL").count() == 0 and calls.value == before
