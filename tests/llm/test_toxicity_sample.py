"""The toxicity classifier's samples: their bounds, and what repeated ids and texts do to them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import toxicity


def test_samples_are_not_cut_below_their_first_size():
    assert toxicity.MAX_LABELLED >= 8_000 and toxicity.MAX_TRAINING >= 8_000
    assert toxicity.train.__defaults__[-3:] == (toxicity.MAX_LABELLED, toxicity.MAX_TRAINING, toxicity.MAX_SAMPLE_CHARS)


def test_repeated_ids_do_not_widen_the_samples(spark, monkeypatch):
    """Two hundred texts under one labelled id, half of them copies: the bound is on texts."""
    rows = [(1, f"you stupid idiot number {i % 100}") for i in range(200)] + [(i, f"plain words about garden {i}") for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), *((i, 0) for i in range(2, 60))], "doc_id long, toxic int")
    fitted = []
    monkeypatch.setattr(toxicity.Linear, "fit", lambda self, rows, y, weight: fitted.append((len(rows), np.asarray(y), np.asarray(weight))) or self)
    toxicity.train(docs, labels, max_labelled=50, max_training=40)
    assert fitted[0][0] == 40 and len(fitted[0][1]) == 40
    # weights stand for rows: those with votes for 200, the others for 58
    weight, y = fitted[0][2], fitted[0][1]
    assert weight[y > 0.5].sum() / weight.sum() == pytest.approx(200 / 258, rel=0.02)
    texts = docs.select(F.col("doc_id").alias("id"), "text", F.xxhash64("text").alias("key"))
    keys = texts.groupBy("key").agg(F.max(F.length("text")).alias("n"))
    first = toxicity.first_keys(keys, 30, 10_000)
    assert toxicity.sampled(texts, first).count() == 30
    assert 0 < toxicity.first_keys(keys, 1000, 500).join(keys, "key").agg(F.sum("n")).first()[0] <= 500


def test_families_against_plain_counts(spark):
    word = lambda i: chr(97 + i % 26) * (1 + i // 26)
    texts = [(i, f"grubbing zorgle words {word(i)}", 1) for i in range(8)] + [(100 + i, f"gentle garden words {word(i)} grub", 0) for i in range(40)] + [(8, "Grubbing, zorgle WORDS a", 1)]
    sample = spark.createDataFrame(texts, "key long, text string, toxic int")
    seen, bad, good, n = set(), {}, {}, [0, 0]
    for _, t, y in texts:
        words = toxicity.word_set(t)
        if (words, y) in seen:
            continue
        seen.add((words, y))
        n[y] += 1
        for f in {w[:k] for w in words for k in range(4, 9) if len(w) >= k}:
            to = bad if y else good
            to[f] = to.get(f, 0) + 1
    want = toxicity.chosen_families([(f, b, good.get(f, 0)) for f, b in bad.items()], n[1], n[0])
    assert toxicity.mine_families(sample) == want and "grubb" in want and "word" not in want


def test_posterior_is_that_of_the_enumerated_joint():
    """The tree's posterior against the joint probabilities of all vote patterns, which sum to one."""
    rng = np.random.RandomState(3)
    masks = np.arange(16)
    m = toxicity.LabelModel(4).fit(masks, rng.randint(1, 50, 16))
    joint = np.zeros((2, 16))
    for y in (0, 1):
        for mask in masks:
            p = m.prior if y else 1 - m.prior
            for k in range(4):
                z = 0 if m.parent[k] < 0 else mask >> m.parent[k] & 1
                on = m.table[y, k, z]
                p *= on if mask >> k & 1 else 1 - on
            joint[y, mask] = p
    assert joint.sum() == pytest.approx(1)
    assert m.posterior(masks) == pytest.approx(joint[1] / joint.sum(0))


def test_scores_are_those_of_the_whole_feature_vector(spark):
    rng = np.random.RandomState(5)
    linear = toxicity.Linear(rng.normal(0, 0.3, 1 << toxicity.HASH_BITS).astype(np.float32), -0.2)
    for text in ("Some plain words, and words again", "x", "einz größere Wörter " * 50):
        slots, x = linear.features(text, {})
        z = float(linear.w[slots].astype(float) @ x.astype(float)) - 0.2
        assert linear.score(text.lower()) == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-5)
    assert linear.score("... !!") == 0.0
