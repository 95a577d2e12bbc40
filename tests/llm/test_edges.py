"""Every operator on nulls, empty and long texts, repeated rows, clashing columns and empty tables; the pipeline's stages."""

import pytest

import corpus_pipeline
from corvane.llm import bpe, fingerprint, langid, packing, pii, quality_classifier, quality_rules, simhash, toxicity

LONG = "word " * 30_000 + "x" * 50_000
ROWS = [(1, None, "en", "s", None), (2, "", None, None, 0), (3, LONG, "en", "s", 1), (4, "Some plain words here.", "en", "s", 2), (4, "Some plain words here.", "en", "s", 2), (None, "other words", "fr", None, 3), (None, None, None, None, None), (5, "!!! ??? ...", "", "t", 4), (6, "你好 мир 😀", "xx", "t", 5)]
CLASH = "n_tokens int, hi int, host int, score int, votes int, text_ int, __id int, stratum int, bin int, length int, keep int, path int"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, *([7] * len(CLASH.split(",")))) for r in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + CLASH)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0, 9), (5, 0, 1, 9), (4, 1, 0, 9), (None, 1, 1, 9), (3, None, None, 9), (99, 1, 0, 9)], "doc_id long, quality int, toxic int, text int")


def operators(labels):
    return {
        1: lambda d: bpe.encode_documents(d),
        2: lambda d: bpe.token_counts(d),
        3: lambda d: pii.find_in_documents(d),
        4: lambda d: fingerprint.group_documents(d),
        5: lambda d: quality_rules.apply_rules(d, labels),
        7: lambda d: langid.identify_documents(d, langid.train(d)),
        8: lambda d: simhash.near_duplicates(d),
        9: lambda d: toxicity.score_documents(d, labels),
        10: lambda d: quality_classifier.classify(d, labels),
    }


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 8, 9, 10])
def test_a_row_for_each_row(spark, odd, labels, n):
    run = operators(labels)[n]
    out = run(odd).collect()
    assert sorted((r["doc_id"] for r in out), key=str) == sorted((r[0] for r in ROWS), key=str)
    assert run(odd.limit(0)).collect() == []
    assert len(run(odd.where("text IS NULL")).collect()) == 2


def test_packing(odd):
    out = packing.pack_documents(odd).toPandas()
    n = {r["doc_id"]: r["n_tokens"] for r in bpe.token_counts(odd).where("doc_id = 3").collect()}
    assert out[out.doc_id == 3].length.sum() == n[3] and (out[out.doc_id == 3].n_pieces > 1).all()
    assert out[out.doc_id.isin([1, 2])].bin.isna().all() and len(out[out.doc_id == 4]) == 2
    assert packing.pack_documents(odd.limit(0)).collect() == []


def test_null_and_empty_texts_have_the_stated_results(odd):
    one = {r["doc_id"]: r for r in bpe.encode_documents(odd).where("doc_id IN (1, 2, 6)").collect()}
    assert one[1]["token_ids"] is None and one[2]["token_ids"] == [] and one[2]["round_trip"] and one[6]["round_trip"]
    back = {r["doc_id"]: r["text"] for r in bpe.decode_tokens(bpe.encode_documents(odd)).collect() if r["doc_id"] is not None}
    assert back == {r[0]: r[1] for r in ROWS if r[0] is not None}
    two = {r["doc_id"]: r for r in bpe.token_counts(odd).where("doc_id IN (1, 2)").collect()}
    assert two[1]["n_tokens"] is None and two[2]["n_tokens"] == 0 and two[2]["keep_512"] == 0
    assert {r["doc_id"]: r["digest"] for r in fingerprint.fingerprint_documents(odd).collect()}[1] is None


def test_stated_results_of_the_other_operators(odd, labels):
    """Null, empty and wordless texts, and rows without an id, under operators 3, 4, 5 and 7 to 10."""
    by = lambda df: {r["doc_id"]: r for r in df.collect() if r["doc_id"] is not None}
    three = by(pii.find_in_documents(odd))
    assert three[1]["found"] is None and three[1]["redacted"] is None and three[2]["found"] == [] and three[2]["redacted"] == "" and three[3]["redacted"] == LONG
    four = by(fingerprint.group_documents(odd))
    assert [(four[i]["digest"], four[i]["class_id"], four[i]["n_links"], four[i]["group_id"]) for i in (1, 2, 4)] == [(None, i, 0, i) for i in (1, 2, 4)]
    assert all(r["class_id"] is None and r["group_id"] is None and r["n_links"] == 0 for r in fingerprint.group_documents(odd).where("doc_id IS NULL").collect())
    five = by(quality_rules.apply_rules(odd, labels))
    assert all(five[i]["broken"] == "" and five[i]["keep"] for i in (1, 2)) and five[2]["stratum"] == "" and five[2]["symbols"] == 0.0
    seven = by(langid.identify_documents(odd, langid.train(odd)))
    assert all(r["language"] is None and r["confidence"] is None for r in seven.values())  # no label has enough texts
    eight = simhash.near_duplicates(odd).collect()
    held = {r["doc_id"]: r for r in eight if r["doc_id"] is not None}
    assert all(held[i]["group_id"] == i and held[i]["keep"] and held[i]["n_links"] == 0 for i in (1, 2, 3, 5, 6))
    assert sorted(r["keep"] for r in eight if r["doc_id"] == 4) == [False, True] and all(r["keep"] and r["group_id"] is None for r in eight if r["doc_id"] is None)
    nine = by(toxicity.score_documents(odd, labels))
    assert nine[1]["score"] is None and nine[1]["toxic"] is None and nine[2]["score"] == 0.0 and nine[5]["score"] == 0.0 and not any(r["toxic"] for r in nine.values())
    ten = by(quality_classifier.classify(odd, labels))
    assert ten[2]["host"] == "" and ten[2]["path"] == "" and ten[1]["evidence"] == ten[2]["evidence"]


def test_without_labels(spark, odd, labels):
    none = labels.limit(0)
    assert quality_rules.apply_rules(odd, none).where("NOT keep").count() == 0
    assert quality_classifier.classify(odd, none).where("NOT keep").count() == 0 and quality_classifier.keep_good(odd, none).count() == len(ROWS)
    assert toxicity.score_documents(odd, none).where("toxic").count() == 0 and toxicity.keep_harmless(odd, none).count() == len(ROWS)
    assert toxicity.keep_harmless(odd.limit(0), labels).count() == 0 and quality_classifier.keep_good(odd.limit(0), labels).count() == 0


def test_stages_keep_columns_and_handle_odd_rows(spark, odd, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "packing":
                assert out.columns == docs.columns, name
            out.collect()


def test_the_pipeline_on_documents(spark, sf):
    """Each stage against what its operator says of each row, and the whole against its parts."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "toxicity", "near_duplicates", "pii", "packing"]
    stages = dict(corpus_pipeline.STAGES)
    at = docs.cache()
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    good = stages["quality_classifier"](spark, at, sf).cache()
    assert ids(good) == ids(quality_classifier.classify(at, labels).where("keep"))
    mild = stages["toxicity"](spark, good, sf).cache()
    assert ids(mild) == ids(toxicity.score_documents(good, labels).where("NOT toxic"))
    once = stages["near_duplicates"](spark, mild, sf).cache()
    assert ids(once) == ids(simhash.near_duplicates(mild).where("keep"))
    clean = stages["pii"](spark, once, sf).cache()
    assert {r["doc_id"]: r["text"] for r in clean.collect()} == {r["doc_id"]: pii.redact(r["text"], pii.find(r["text"])) for r in once.collect()}
    packed = stages["packing"](spark, clean, sf)
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, packed.collect())) == sorted(map(tuple, whole.collect()))
