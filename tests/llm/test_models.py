"""Digests, thresholds, packing, language, SimHash, label model and shrinkage against brute force."""

import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corvane.llm.features import feature_columns
from corvane.llm import bpe, fingerprint, langid, packing, quality_classifier, quality_rules, simhash, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents():
    return pq.read_table(f"{SF}/documents.parquet").to_pandas()


# ---- 4: fingerprints


def slow_counts(data):
    out = [0] * 128
    for at in range(len(data) - 4):
        w = data[at : at + 5]
        for s, (i, j, k) in enumerate(fingerprint.TRIPLETS):
            h = fingerprint._mix[fingerprint._PAIR[s][w[i] << 8 | w[j]] ^ w[k]]
            out[int(h) % 128] += 1
    return out


def test_digest_against_plain_loops():
    rnd = random.Random(2)
    for n in (0, 4, 50, 300):
        data = bytes(rnd.randrange(256) for _ in range(n))
        assert fingerprint.bucket_counts(data).tolist() == slow_counts(data)


def test_difference_is_bounded_and_small_for_near_copies():
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    text = " ".join(words)
    near = " ".join(words[:200] + ["changed"] + words[201:])
    other = " ".join("".join(rnd.choice("mnopqrst") for _ in range(6)) for _ in range(400))
    a, b, c = (fingerprint.digest(t.encode()) for t in (text, near, other))
    assert len(a) == 70 and fingerprint.difference(a, a) == 0
    assert fingerprint.difference(a, b) == fingerprint.difference(b, a) < 40 < fingerprint.difference(a, c) <= fingerprint.MAX_DIFFERENCE
    assert fingerprint.digest(b"short") is None and fingerprint.difference(a, None) is None
    rows = [np.frombuffer(bytes.fromhex(x), np.uint8) for x in (a, c)]
    slow = sum(6 if abs(x - y) == 3 else abs(x - y) for p, q in zip(rows[0][3:], rows[1][3:]) for x, y in zip(((int(p) >> s) & 3 for s in (6, 4, 2, 0)), ((int(q) >> s) & 3 for s in (6, 4, 2, 0))))
    assert 0 <= fingerprint.difference(a, c) - slow <= fingerprint.HEAD_LIMIT


def test_digest_codes_and_head_by_definition():
    rnd = random.Random(9)
    data = bytes(rnd.randrange(97, 123) for _ in range(700))
    counts = slow_counts(data)
    q1, q2, q3 = (sorted(counts)[k] for k in (31, 63, 95))
    codes = [sum(c > q for q in (q1, q2, q3)) for c in counts]
    raw = bytes.fromhex(fingerprint.digest(data))
    assert [raw[3 + i // 4] >> (6 - 2 * (i % 4)) & 3 for i in range(128)] == codes
    assert raw[1] == int(math.log(700) / math.log(1.1)) & 255 and raw[2] == (q1 * 15 // q3) << 4 | q2 * 15 // q3
    assert fingerprint.digest(b"a" * 5_000) is None and fingerprint.digest(b"ab" * 5_000) is None


def test_links_are_all_pairs_within_the_score(spark, documents):
    """The search against all pairs, the SQL's score against the plain one, for two thresholds."""
    docs = spark.createDataFrame(documents)
    classes = fingerprint._prints(docs, "doc_id", "text").where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("node"), *[F.first(c).alias(c) for c in fingerprint._CODED]).cache()
    held = classes.select("node", "digest").toPandas().sort_values("node", ignore_index=True)
    rows = np.array([np.frombuffer(bytes.fromhex(d), np.uint8) for d in held.digest])
    ids = held.node.tolist()
    scores = {(ids[i], ids[j]): int(s) for i in range(len(ids)) for j, s in zip(range(i + 1, len(ids)), fingerprint.differences(np.repeat(rows[i : i + 1], len(ids) - i - 1, 0), rows[i + 1 :]))}
    for link in (fingerprint.LINK, 25):
        got = {(r["a"], r["b"]): r["difference"] for r in fingerprint.linked_digests(classes, link).collect()}
        assert got == {p: s for p, s in scores.items() if s <= link} and got
    a, b = (classes.where("node % 40 = 0").select(*[F.col(c).alias(f"{n}_{c}") for c in ("node", *fingerprint._CODED)]) for n in "ab")
    for r in a.crossJoin(b).where("a_node < b_node").select("a_node", "b_node", F.expr(fingerprint.score_sql("a_", "b_")).alias("s")).collect():
        assert r["s"] == scores[r["a_node"], r["b_node"]]


def test_documents_by_class_and_group(spark):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(900)]
    a, near, other = " ".join(words), " ".join(words) + " too", " ".join(reversed([w[::-1] for w in words]))
    rows = [(5, a), (3, a), (9, near), (7, other), (7, other), (8, "short"), (2, None), (4, ""), (None, a), (6, "x" * 9_000)]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, digest string")
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"], r["group_id"]) for r in fingerprint.group_documents(docs).collect()), key=str)
    assert fingerprint.difference(*(fingerprint.digest(t.encode()) for t in (a, near))) <= fingerprint.LINK
    assert got == sorted([(5, 3, 1, 3), (3, 3, 1, 3), (9, 9, 1, 3), (7, 7, 0, 7), (7, 7, 0, 7), (8, 8, 0, 8), (2, 2, 0, 2), (4, 4, 0, 4), (6, 6, 0, 6), (None, None, 0, None)], key=str)
    assert fingerprint.group_documents(docs.limit(0)).collect() == []


# ---- 5: rules


def test_binomial_bounds_are_exact():
    for n, k, p in ((10, 3, Fraction(1, 4)), (40, 0, Fraction(1, 100)), (25, 24, Fraction(9, 10))):
        want = sum(Fraction(math.comb(n, i)) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert quality_rules.binomial_cdf(k, n, float(p)) == pytest.approx(float(want), rel=1e-9)
    assert quality_rules.binomial_cdf(0, 0, 0.1) == 1
    u = quality_rules.upper_bound(2, 100, 0.05)
    assert quality_rules.binomial_cdf(2, 100, u) == pytest.approx(0.05, rel=1e-6)


def test_thresholds_against_brute_force(spark):
    rnd = np.random.RandomState(0)
    n = 3000
    x = np.where(rnd.rand(n) < 0.1, rnd.rand(n), rnd.rand(n) * 0.1)
    f = pd.DataFrame({"doc_id": range(n), "stratum": "s", "copy": [str(i) for i in range(n)], **{r: (x if r == "symbols" else 0.0) for r in quality_rules.NAMES}})
    labels = pd.DataFrame({"doc_id": range(n), "quality": (x < 0.5).astype(int)})
    got = quality_rules.thresholds(spark.createDataFrame(f), spark.createDataFrame(labels)).toPandas().set_index("rule").loc["symbols"]
    good = x[x < 0.5]
    alpha, level = quality_rules.RISK / len(quality_rules.NAMES), quality_rules.DELTA / len(quality_rules.NAMES)
    best = None
    for c in reversed(quality_rules.GRID):
        if quality_rules.binomial_cdf(int((good > c).sum()), len(good), alpha) > level:
            break
        best = c
    assert got["cutoff"] == best and got["n_rejected"] == (good > best).sum() and got["bound"] <= alpha


def test_too_few_labels_reject_nothing(spark):
    docs = spark.createDataFrame([(1, "$$$$ %%%%", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality_rules.apply_rules(docs, labels).select("keep").first()[0] is True


def test_copies_are_one_trial(spark):
    """Twenty texts a thousand times over show no more than twenty."""
    rows = [(40 * i + k, f"Good plain text number {i}, of some eight words or so.", "en") for i in range(20) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], 1) for r in rows], "doc_id long, quality int")
    features = docs.select("doc_id", F.col("lang").alias("stratum"), F.md5("text").alias("copy"), *[F.lit(0.0).alias(n) for n in quality_rules.NAMES])
    got = quality_rules.thresholds(features, labels).collect()
    level = quality_rules.DELTA / len(quality_rules.NAMES)
    assert len(got) == len(quality_rules.NAMES)
    for r in got:
        assert r["n_good"] == 20 and r["cutoff"] is None and r["bound"] == pytest.approx(quality_rules.upper_bound(0, 20, level))
    assert quality_rules.apply_rules(docs, labels).where("NOT keep").count() == 0


# ---- 6: packing


def slow_packing(lengths, capacities, overhead):
    """Best fit one item at a time."""
    items = sorted(lengths, reverse=True)
    bins = []  # [room, opened, items]
    for i, length in enumerate(items):
        fits = [b for b in bins if b[0] >= length]
        if fits:
            b = min(fits, key=lambda b: b[0])
        else:
            pending = sum(1 for x in items[i:] if x == length)
            c = packing._opened(length, pending, sum(x for x in items if x < length), capacities, overhead)
            b = [c, c, []]
            bins.append(b)
        b[0] -= length
        b[2].append(length)
    return Counter((next(c for c in capacities if c >= o - r), tuple(sorted(x))) for r, o, x in bins)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_sequential_best_fit(seed):
    rnd = random.Random(seed)
    caps = (16, 32, 64)
    lengths = [min(64, int(rnd.expovariate(0.08)) + 1) for _ in range(rnd.choice((1, 5, 60, 400)))]
    runs, ranges = packing.plan(Counter(lengths), caps, 3)
    held = {}
    for length, _, n, first, each, _ in runs.tolist():
        for k in range(n):
            held.setdefault(first + k // each, []).append(length)
    capacity = {b: c for first, n, c, _ in ranges.tolist() for b in range(first, first + n)}
    assert Counter((capacity[b], tuple(sorted(x))) for b, x in held.items()) == slow_packing(lengths, caps, 3)


def test_packed_rows_fill_bins_without_overlap(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice([None, 0, -1, 1, 5, 40, 64, 65, 200, rnd.randrange(1, 64)])) for i in range(500)] + [(None, 7), (3, 9), (3, 9)]
    out = packing.pack_lengths(spark.createDataFrame(rows, "doc_id long, length int"), (16, 32, 64)).toPandas()
    assert out["length"].sum() == sum(max(0, n or 0) for _, n in rows)
    for _, b in out[out["bin"].notna()].groupby("bin"):
        b = b.sort_values("offset")
        assert b["offset"].tolist() == [0, *b["length"].cumsum().tolist()[:-1]] and b["length"].sum() <= b["capacity"].iloc[0]
    assert (out["bin"].isna() == (out["length"] == 0)).all()


def test_cells_do_not_change_the_packing(spark):
    """A hot length in many cells gives the same bins of lengths; each document has its own place."""
    rows = [(i, 5 if i % 3 else 1 + i % 60) for i in range(900)] + [(2000, None)]
    items = spark.createDataFrame(rows, "doc_id long, length int")
    bins = []
    for cell_rows in (1_000_000, 50):
        out = packing.pack_lengths(items, (16, 32, 64), cell_rows=cell_rows).toPandas()
        assert sorted(out.doc_id) == sorted(i for i, _ in rows)
        held = out[out.bin.notna()]
        assert not held.duplicated(["bin", "offset"]).any()
        bins.append(Counter(tuple(sorted(b.length)) for _, b in held.groupby("bin")))
    assert bins[0] == bins[1]


def test_long_items_of_one_length_are_not_one_task(spark, monkeypatch):
    """Cells are bounded by tokens too, so that rows which carry them don't pile up in one task."""
    monkeypatch.setattr(packing, "CELL_TOKENS", 64 * 20, raising=False)
    rows = [(i, 64 if i < 400 else 1 + i % 30) for i in range(500)]
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = packing.pack_lengths(spark.createDataFrame(rows, "doc_id long, length int"), (16, 32, 64))
        out = out.withColumn("task", F.spark_partition_id()).toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    assert out[out.length == 64].task.nunique() > 1
    assert sorted(zip(out.doc_id, out.length)) == sorted(rows)
    assert not out.duplicated(["bin", "offset"]).any()
    held = Counter(tuple(sorted(b.length)) for _, b in out.groupby("bin"))
    monkeypatch.setattr(packing, "CELL_TOKENS", 10**9, raising=False)
    one = packing.pack_lengths(spark.createDataFrame(rows, "doc_id long, length int"), (16, 32, 64)).toPandas()
    assert held == Counter(tuple(sorted(b.length)) for _, b in one.groupby("bin"))


def test_packed_tokens_are_the_documents(spark, documents):
    """Pieces in order give each text's tokens; a bin's pieces fill it from its start without gaps."""
    docs = spark.createDataFrame(documents.head(120))
    out = packing.pack_documents(docs, (64, 256), tokens=True).toPandas()
    codec = bpe.Codec.of(bpe.read_vocabulary())
    for i, b in out.sort_values("piece").groupby("doc_id"):
        text = documents.text[documents.doc_id == i].iloc[0]
        assert [t for x in b.token_ids for t in x] == codec.encode(text).tolist()
    assert (out.token_ids.str.len() == out.length).all()
    for _, b in out[out.bin.notna()].sort_values("offset").groupby("bin"):
        assert b.offset.tolist() == [0, *b.length.cumsum().tolist()[:-1]]
    plain = packing.pack_documents(docs, (64, 256)).toPandas()
    assert set(map(tuple, plain.to_numpy().tolist())) == set(map(tuple, out[plain.columns].to_numpy().tolist()))


# ---- 7: language


def test_gradients_are_right():
    net = langid.Network(["a", "b"], seed=3)
    rng = np.random.RandomState(1)
    x, y = rng.randint(0, 256, (5, langid.WINDOW)), np.array([0, 1, 0, 1, 1])

    def loss():
        pooled = []
        for f, b, w in zip(net.f, net.b, langid.WIDTHS):
            z = sum(net.e[x][:, j : x.shape[1] - w + 1 + j] @ f[j] for j in range(w)) + b
            pooled.append(z.max(1))
        s = np.maximum(np.concatenate(pooled, 1), 0) @ net.w + net.c
        return -np.mean(s[np.arange(5), y] - np.log(np.exp(s).sum(1)))

    for p, g in zip(net.parameters(), net._gradients(x, y)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        p[at] += 1e-5
        up = loss()
        p[at] -= 2e-5
        down = loss()
        p[at] += 1e-5
        assert g[at] == pytest.approx((up - down) / 2e-5, rel=1e-2, abs=1e-6)


def test_held_out_accuracy_and_batches(spark, documents):
    docs = spark.createDataFrame(documents)
    net = langid.train(docs.where("doc_id % 2 = 0"), texts_each=100)
    held = documents[(documents.doc_id % 2 == 1) & (documents.text.str.len() > 100)]
    names, _ = langid.Applier(net).identify(held.text.tolist())
    assert np.mean(np.array(names) == held.lang.to_numpy()) > 0.97
    one, sure = langid.Applier(langid.Network.load(net.dump())).identify([held.text.iloc[0], None, ""])
    assert one == [names[0], None, None] and sure[1:] == [None, None]


def test_merged_tables_are_the_convolution(documents):
    """The scan's tables by pairs of bytes against embedding, filters, maxima and softmax as defined."""
    net = langid.Network(["a", "b", "c"], seed=4)
    x = np.concatenate([langid.windows(t.encode())[0] for t in documents.text.iloc[:20] if t])[:50]
    pooled = []
    for f, b, w in zip(net.f, net.b, langid.WIDTHS):
        z = np.array([[sum(net.e[row[i + j]] @ f[j] for j in range(w)) + b for i in range(len(row) - w + 1)] for row in x[:8]])
        pooled.append(z.max(1))
    s = np.maximum(np.concatenate(pooled, 1), 0) @ net.w + net.c
    want = s - np.log(np.exp(s).sum(1, keepdims=True))
    assert langid.Applier(net).log_probabilities(x[:8]) == pytest.approx(want, abs=1e-4)
    assert langid.Applier(net).log_probabilities(x)[:8] == pytest.approx(want, abs=1e-4)


def test_no_language_is_left_out(spark):
    """300 labels share the bound; copies and null ids add nothing."""
    rows = [(None, chr(0x4E00 + k) * 30 + f" {i}", f"l{k:03d}") for k in range(300) for i in range(6)] + [(7, "same", "copies")] * 50 + [(8, None, "null"), (9, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.train(docs, texts_each=6, max_texts=1_500)
    assert set(net.languages) == {f"l{k:03d}" for k in range(300)}
    assert langid.train(docs.where("lang = 'copies'")) is None and langid.train(docs.limit(0)) is None


# ---- 8: SimHash


def test_recall_against_all_pairs(spark, documents):
    v = {i: simhash.sums(t) for i, t in zip(documents.doc_id, documents.text)}
    prints, ids = {}, {}
    for i, x in v.items():
        if x is not None:
            key = (x > 0).tobytes()
            ids.setdefault(key, i)
            prints[ids[key]] = x > 0
    keys = sorted(prints)
    b = np.array([prints[k] for k in keys])
    near = {(keys[i], keys[j]) for i in range(len(keys)) for j in range(i + 1, len(keys)) if (b[i] != b[j]).sum() <= simhash.TAU}
    docs = spark.createDataFrame(documents)
    nodes = simhash.fingerprints(docs).groupBy("hi", "lo").agg(F.min("doc_id").alias("node"), F.first("weak").alias("weak"))
    got = {tuple(r) for r in simhash.similar_pairs(nodes).collect()}
    assert got <= near and len(got) >= 0.98 * len(near) and near


def test_recall_on_the_larger_table_and_links(spark):
    """Over 0.99 of a thousand links; the link counts are those of the pairs found; few unlike documents meet."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    nodes = simhash.fingerprints(docs).where("hi IS NOT NULL").groupBy("hi", "lo").agg(F.min("doc_id").alias("node"), F.min_by("weak", "doc_id").alias("weak")).cache()
    plain = nodes.toPandas()
    x = plain[["hi", "lo"]].to_numpy(np.int64).view(np.uint64)
    near = set()
    for i in range(0, len(x), 256):
        a, b = np.nonzero(np.bitwise_count(x[i : i + 256, None, :] ^ x[None]).sum(2) <= simhash.TAU)
        near |= {(int(min(p, q)), int(max(p, q))) for p, q in zip(plain.node.to_numpy()[a + i], plain.node.to_numpy()[b]) if p != q}
    got = {tuple(r) for r in simhash.similar_pairs(nodes).collect()}
    assert got <= near and len(got) >= 0.99 * len(near) and len(near) > 1000
    links = Counter(n for p in got for n in p)
    grouped = simhash.near_duplicates(docs).toPandas()
    of = dict(zip(grouped.doc_id, grouped.n_links))
    assert all(of[n] == links.get(n, 0) for n in plain.node)
    each = simhash.entered(nodes)
    met = each.join(each.select("entry", F.col("node").alias("b")), "entry").where("node < b").select("node", "b").distinct().count()
    assert met < 10 * len(near)


def test_segments_turn_to_their_place():
    """The SQL's turned rings, entries and sets against whole bit strings."""
    assert simhash.SETS[0] == () and len(set(simhash.SETS)) == simhash.PROBES
    v = np.random.RandomState(1).randint(-9, 10, (1, 128))
    halves, weak = simhash.signatures(v)
    bits = "".join("1" if x > 0 else "0" for x in v[0])
    assert [f"{int(h) & (1 << 64) - 1:064b}" for h in halves[0]] == [bits[:64], bits[64:]]
    for k in range(4):
        order = sorted(range(32), key=lambda i: (abs(v[0][32 * k + i]), i))[: simhash.UNCERTAIN]
        assert [31 - i for i in order] == weak[0][k].tolist()


@pytest.mark.parametrize("tau", [0, 3, 8, 20, 31, 64])
def test_both_searches_find_what_all_pairs_show(tau, monkeypatch):
    """Parts that can't all be missed, and each link once by either way, whatever is held at a time."""
    split = simhash.parts(tau)
    n = max(simhash.LEAST_PARTS, tau // 3 + 1)
    assert sum(r + 1 for _, _, r in split) == tau + 1 and len(split) <= n
    rng = np.random.default_rng(tau)
    base = rng.integers(0, 2, (150, 128))
    bits = np.concatenate([base] + [base ^ (rng.random(base.shape) < p) for p in (tau / 128, tau / 160, 0.02)])
    x = np.packbits(bits.astype(bool), axis=1).view(">u8").astype(np.uint64).T.copy()
    a, b = x[:, ::2].copy(), x[:, 1::2].copy()
    near = set(zip(*(k.tolist() for k in np.nonzero(np.bitwise_count(a.T[:, None] ^ b.T[None]).astype(int).sum(2) <= tau))))
    for chunk in (1 << 18, 7):
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        for way in (simhash._product, simhash._probed) if tau <= 31 else (simhash._product,):
            got = [(int(p), int(q)) for i, j in way(a, b, tau) for p, q in zip(i, j)]
            assert len(got) == len(set(got)) and set(got) == near


def test_links_at_the_threshold_in_certain_bits(spark, monkeypatch):
    """Five bits of each segment, none of those that would be probed; in one block and in many."""
    rng = np.random.default_rng(2)
    rows = []
    for k in range(60):
        x = [int(v) for v in rng.integers(-(2**62), 2**62, 2)]
        far = (0x01F00000 << 32) | 0x01F00000
        rows += [(f"a{k}", x[0], x[1], "ABCDEFGHIJKL" * 4), (f"b{k}", x[0] ^ far, x[1] ^ far, "ABCDEFGHIJKL" * 4)]
    nodes = spark.createDataFrame([*rows, ("none", None, None, None)], "node string, hi long, lo long, weak string")
    for most in (simhash.BLOCK_ROWS, 15):
        monkeypatch.setattr(simhash, "BLOCK_ROWS", most)
        assert sorted(map(tuple, simhash.similar_pairs(nodes).collect())) == sorted((f"a{k}", f"b{k}") for k in range(60))
    assert simhash.similar_pairs(nodes, 19).count() == 0 and simhash.similar_pairs(nodes.limit(0)).count() == 0


def test_every_link_of_the_larger_table_is_counted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    nodes = simhash.fingerprints(docs).where("hi IS NOT NULL").groupBy("hi", "lo").agg(F.min("doc_id").alias("node")).toPandas()
    x = nodes[["hi", "lo"]].to_numpy(np.int64).view(np.uint64)
    links = np.concatenate([(np.bitwise_count(x[i : i + 256, None, :] ^ x[None]).sum(2) <= simhash.TAU).sum(1) - 1 for i in range(0, len(x), 256)])
    of = {r["doc_id"]: r["n_links"] for r in simhash.near_duplicates(docs).collect()}
    assert links.sum() > 2000 and [of[n] for n in nodes.node] == links.tolist()


def test_components_are_those_of_union_find(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 440)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def test_copies_and_near_copies_are_one_group(spark):
    rnd = random.Random(6)
    make = lambda n: [f"w{rnd.randrange(5000)}" for _ in range(n)]
    a, b = make(200), make(200)
    near = a[:100] + ["other"] + a[101:]
    rows = [(5, " ".join(a)), (2, " ".join(a)), (9, " ".join(near)), (7, " ".join(b)), (8, None), (4, ""), (None, " ".join(a)), (7, " ".join(b))]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, hi int")
    got = sorted(((r["doc_id"], r["group_id"], r["keep"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 2, False), (2, 2, True), (9, 2, False), (7, 7, True), (7, 7, False), (8, 8, True), (4, 4, True), (None, None, True)], key=str)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([2, 7, 8, 4, None], key=str)


def test_the_pipeline_keeps_one_of_each_linked_pair(spark):
    """Texts that differ in some words, at most ``TAU`` bits apart: of all pairs one stays."""
    import corpus_pipeline

    rnd, docs, left = random.Random(9), [], 0
    bits = lambda t: simhash.sums(t) > 0
    while left < 300:
        a = [f"w{rnd.randrange(10**6)}" for _ in range(60)]
        b = [f"w{rnd.randrange(10**6)}" if k < 8 else w for k, w in enumerate(a)]
        if 16 <= (bits(" ".join(a)) != bits(" ".join(b))).sum() <= simhash.TAU:
            docs += [(2 * left, " ".join(a)), (2 * left + 1, " ".join(b))]
            left += 1
    kept = corpus_pipeline.distinct(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [2 * k for k in range(300)]


# ---- 9: toxicity


def test_label_model_finds_accuracies_and_a_correlation():
    rng = np.random.RandomState(0)
    n, y = 40_000, None
    y = rng.rand(n) < 0.2
    votes = [np.where(y, rng.rand(n) < a, rng.rand(n) < b) for a, b in ((0.8, 0.02), (0.6, 0.05), (0.7, 0.01), (0.5, 0.02))]
    votes.append(np.where(rng.rand(n) < 0.9, votes[1], rng.rand(n) < 0.1))  # a copy of the second, nearly
    masks = sum(v.astype(int) << k for k, v in enumerate(votes))
    m, c = np.unique(masks, return_counts=True)
    model = toxicity.LabelModel(5).fit(m, c)
    assert abs(model.prior - 0.2) < 0.03
    assert model.parent[4] == 1 or model.parent[1] == 4
    p = model.posterior(masks)
    assert np.mean((p > 0.5) == y) > 0.95


def test_insults_in_disguise_get_votes():
    v = toxicity.Voters(["zzgrub"])
    name = lambda mask: {n for k, n in enumerate(toxicity.VOTERS) if mask >> k & 1}
    assert {"aimed", "two_insults"} <= name(v.votes("you are a stupid idiot"))
    assert "disguised" in name(v.votes("what an 1d10t he is"))
    assert "spelled_out" in name(v.votes("m o r o n that he is"))
    assert {"family_once", "family_twice"} <= name(v.votes("zzgrubba and zzgrubbo"))
    assert v.votes("a nobody in the trash") == 0 and v.votes("") == 0


def test_toxic_documents_are_found_and_clean_ones_left(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.score_documents(docs, labels).join(labels.select("doc_id", F.col("toxic").alias("y")), "doc_id").toPandas()
    assert got[got.y == 1]["toxic"].astype(bool).mean() > 0.9 and got[got.y == 0]["toxic"].astype(bool).mean() < 0.01


# ---- 10: quality


def test_shrinkage_against_plain_loops(spark):
    rnd = random.Random(8)
    rows = [(f"h{h}", f"p{p}", min(1.0, max(0.0, rnd.gauss(0.3 + 0.1 * h, 0.2)))) for h in range(5) for p in range(3) for _ in range(rnd.randrange(1, 60))]
    got = {(r["host"], r["path"]): r for r in quality_classifier.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double")).collect()}
    sums = {}
    for h, p, x in rows:
        for key in (("", ""), (h, ""), (h, p)):
            n, s = sums.get(key, (0, 0.0))
            sums[key] = n + 1, s + x

    def k(groups):  # (n, s, mean above)
        total = sum(n for n, _, _ in groups)
        noise = sum(n * m * (1 - m) for n, _, m in groups) / total
        spread = (sum(n * (s / n - m) ** 2 for n, s, m in groups) - (len(groups) - 1) * noise) / (total - sum(n * n for n, _, _ in groups) / total)
        return max(1.0, min(1e6, noise / spread - 1)) if spread > 0 and len(groups) > 1 else 1e6

    n, s = sums["", ""]
    mean = s / n
    hosts = {h: sums[h, ""] for h in {r[0] for r in rows}}
    kh = k([(n, s, mean) for n, s in hosts.values()])
    post = {h: (kh * mean + s) / (kh + n) for h, (n, s) in hosts.items()}
    kp = k([(*sums[h, p], post[h]) for h, p in got])
    for (h, p), r in got.items():
        n, s = sums[h, p]
        assert r["global_mean"] == pytest.approx(mean) and r["host_mean"] == pytest.approx(post[h]) and r["path_mean"] == pytest.approx((kp * post[h] + s) / (kp + n))


def test_quality_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality_classifier.classify(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    assert ((got.keep == (got.quality == 1)).mean()) > 0.97 and got[got.quality == 1].keep.mean() > 0.98


def test_repeated_ids_do_not_widen_the_sample(spark):
    docs = spark.createDataFrame([(1, f"text {i % 150}") for i in range(300)] + [(2, "$$$ ### 999")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id long, quality int")
    assert quality_classifier.training_rows(docs, labels, 10, "doc_id", "text").count() == 10
    assert quality_classifier.training_rows(docs, labels, 1, "doc_id", "text").count() == 1
    rows = quality_classifier.training_rows(docs, labels, 1000, "doc_id", "text").toPandas()
    assert len(rows) == 151 and rows.quality.sum() == 150


def test_clashing_columns_and_urls(spark):
    docs = spark.createDataFrame([(1, "Some plain words.", "s", "en", 1, 2, 3, 4, "http://A.org/x/y")], "doc_id long, text string, source string, lang string, __site_host int, __site_path int, __shift int, path int, url string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality_classifier.keep_good(docs, labels).collect() == docs.collect()
    got = quality_classifier.classify(docs, labels, url_col="url").first()
    assert (got["host"], got["path"], got["keep"]) == ("a.org", "x", True)
    assert quality_classifier.keep_good(docs, labels, url_col="url").columns == docs.columns


def test_scores_recomputed(spark, documents):
    """Evidence, site shift and score of each document from the weights and means, in plain Python."""
    docs, labels = spark.createDataFrame(documents), spark.read.parquet(f"{SF}/labels.parquet")
    w = quality_classifier.fit(docs, labels)
    f = docs.select("doc_id", *[c.alias(n) for n, c in feature_columns(F.col("text")).items()]).toPandas().set_index("doc_id")
    own = f[list(quality_classifier.NAMES)].to_numpy(float) @ w[:-1] + w[-1]
    own = dict(zip(f.index, own))
    for r in quality_classifier.classify(docs, labels).collect():
        assert r["evidence"] == pytest.approx(own[r["doc_id"]], rel=1e-9, abs=1e-9)
    some = quality_classifier.classify(docs, labels).toPandas()
    p = np.clip(1 / (1 + np.exp(-some.evidence)), quality_classifier.CLIP, 1 - quality_classifier.CLIP)
    mean = p.mean()
    logit = lambda x: np.log(x / (1 - x))
    want = 1 / (1 + np.exp(-(some.evidence + logit(some.path_mean) - logit(mean))))
    assert some.score.to_numpy() == pytest.approx(want.to_numpy(), rel=1e-6, abs=1e-9) and (some.keep == (some.score >= 0.5)).all()
