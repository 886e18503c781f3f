import random
import zlib

import numpy as np

from concordat.llm import classifier as C

DOCS = "doc_id long, text string, lang string, score string, label string"
LABELS = "doc_id long, quality int, toxic int"


def corpus(spark, n=400):
    rnd = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    good = lambda: " ".join(rnd.choice(words) + rnd.choice(["", ",", "."]) for _ in range(40))
    bad = lambda: " ".join(rnd.choice(words) + rnd.choice(["$$$", "###", "!!"]) for _ in range(40))
    rows = [(i, bad() if i % 4 == 0 else good(), "en", "clash", "clash") for i in range(n)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(n)], LABELS)


def test_held_out_accuracy_and_folds(spark):
    docs, labels = corpus(spark)
    rows = C.score_quality(docs, labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    test = [r for r in rows if r["held_out"]]
    assert len(test) > 80 and np.mean([r["predicted"] == int(r["doc_id"] % 4 != 0) for r in test]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_held_out_labels_are_never_learnt(spark):
    docs, labels = corpus(spark)
    lies = labels.withColumn("quality", C.F.when(C.held_out(C.F.col("doc_id")), 1 - C.F.col("quality")).otherwise(C.F.col("quality")))
    a, b = ({r["doc_id"]: r["score"] for r in C.score_quality(docs, x).collect()} for x in (labels, lies))
    assert a == b


def test_scores_are_sparse_dot_products():
    rnd = np.random.default_rng(1)
    w = rnd.normal(size=C.DIM)
    texts = ["one two", "", None, "one  two\tone two!! One TWO ÉÉ 12a", "x" * 3000, "a b " * 2000]
    for t, got in zip(texts, C.dots(texts, w, 0.3)):
        _, index, n = C.features(C._encode([t]))
        want = 0.3 + sum(w[i] for i in index) * C.SCALE / max(int(n[0]), 1)
        assert np.isclose(got, 1 / (1 + np.exp(-want)))


def test_features_do_not_depend_on_company_or_chunks(monkeypatch):
    texts = [b"alpha beta alpha beta", b"", b"gamma!! gamma", b"word " * 300]
    doc, index, n = C.features(texts)
    for i, t in enumerate(texts):
        _, own, m = C.features([t])
        assert sorted(index[doc == i]) == sorted(own) and n[i] == m[0]
    monkeypatch.setattr(C, "CHUNK", 64)
    doc2, index2, n2 = C.features(texts)
    assert sorted(zip(doc, index)) == sorted(zip(doc2, index2)) and list(n) == list(n2)


def test_chunks_never_cut_a_token(monkeypatch):
    long = "x" * 3000 + "\t" + "Ab9" * 1000 + " \t\n" * 900 + "é" * 2000 + "$" * 700 + "\v".join(f"w{i}" for i in range(500))
    texts = [t.encode() for t in (long, "tab\tseparated\t" * 2000, "日本語" * 700, "a", "", " " * 5000, "end" + " " * 4000 + "End")]
    want = C.features(texts)
    for chunk in (16, 63, 64, 65, 1000):
        monkeypatch.setattr(C, "CHUNK", chunk)
        got = C.features(texts)
        assert sorted(zip(*got[:2])) == sorted(zip(*want[:2])) and list(got[2]) == list(want[2])
    monkeypatch.undo()
    assert C.features([b"ab\t" * 200_000])[2].tolist() == [200_000]
    assert C.features([b"a" * (C.CHUNK + 5) + b" b"])[2].tolist() == [2]


def naive_fit(examples):
    """One coordinate after another, as the updates are written in the literature."""
    import math

    good = sum(y for y, _, _ in examples)
    bias, bias_n = math.log((good + 1) / (len(examples) - good + 1)), 1.0
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= C.L1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return -(z[i] - sign * C.L1) / ((C.BETA + math.sqrt(n[i])) / C.ALPHA + C.L2)

    for _ in range(C.EPOCHS):
        for y, idx, val in examples:
            w = {int(i): weight(int(i)) for i in idx}
            p = 1 / (1 + math.exp(-(sum(w[int(i)] * float(x) for i, x in zip(idx, val)) + bias)))
            for i, x in zip(map(int, idx), map(float, val)):
                g = (p - y) * x
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / C.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
            bias_n += (p - y) ** 2
            bias -= 0.05 / math.sqrt(bias_n) * (p - y)
    return {i: weight(i) for i in z}, bias


def test_fit_is_ftrl_proximal():
    rnd = np.random.default_rng(4)
    examples = []
    for _ in range(60):
        idx = np.sort(rnd.choice(50, rnd.integers(1, 12), replace=False)).astype("<i4")
        examples.append((int(rnd.random() < 0.6), idx, rnd.random(len(idx)).astype("<f4")))
    weights, bias = C.fit(examples)
    want, want_bias = naive_fit(examples)
    assert np.isclose(bias, want_bias) and all(np.isclose(weights[i], w) for i, w in want.items())
    assert np.flatnonzero(weights).tolist() == sorted(i for i, w in want.items() if w)


def test_training_is_bounded_before_its_task(spark, monkeypatch):
    docs, labels = corpus(spark, 60)
    twice = docs.unionByName(docs).unionByName(docs.withColumn("text", C.F.lit(None).cast("string")).limit(5))
    ranked = sorted(r["at"] for r in docs.filter(~C.held_out(C.F.col("doc_id"))).select(C.F.xxhash64("doc_id").alias("at")).collect())
    seen = []
    monkeypatch.setattr(C, "MAX_TRAIN_FEATURES", 300)
    original = C.durable
    monkeypatch.setattr(C, "durable", lambda df: seen.append(original(df)) or seen[-1])
    C.train(twice, labels)
    rows = seen[0].orderBy("at").collect()
    assert [r["at"] for r in rows] == ranked  # one row for an id
    assert sum(r["n_values"] for r in rows) > 300 and all(len(r["idx"]) == 4 * r["n_values"] for r in rows)


def test_odd_tables(spark):
    docs, labels = corpus(spark, 40)
    none = C.score_quality(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert C.score_quality(docs.limit(0), labels).count() == 0
    odd = spark.createDataFrame([(None, None), (1, ""), (1, None), (2, "a" * 100_000), (2, "b")], "doc_id long, text string")
    assert C.score_quality(odd, labels).count() == 5
    strange = spark.createDataFrame([(None, 1, 0), (3, None, 0), (999, 0, 0)], LABELS)
    assert C.score_quality(docs, strange).count() == 40
    kept = C.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= 40


def test_labels_without_a_document_take_no_place(spark, monkeypatch):
    monkeypatch.setattr(C, "MAX_TRAIN_ROWS", 30)
    docs = spark.createDataFrame([(i, ("good plain words " if i % 2 else "$$$ %%% ### ") * 9) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(i, 1) for i in range(1000, 9000)], "doc_id long, quality int")
    assert {r["doc_id"] for r in C.keep_good(docs, labels).collect()} == set(range(1, 60, 2))
