import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from concordat.llm import simhash as S

DOCS = "doc_id long, text string, fp string, component_id string, source string"


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    fps = np.array(fps, np.uint64)
    label = list(range(len(fps)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(fps)):
        for b in np.flatnonzero(np.bitwise_count(fps[a + 1 :] ^ fps[a]) <= 3) + a + 1:
            x, y = root(a), root(int(b))
            label[max(x, y)] = min(x, y)
    return [root(x) for x in range(len(fps))]


def test_fingerprints():
    texts = [None, "", " \n", "One", "one TWO", "A b\x0bc\td", "é É Ü ß x", " a b c d", "a b c " * 40_000, "the quick brown fox " * 5, "x" * 100_000]
    assert [S.fingerprint(t) for t in texts] == [brute_fingerprint(t) for t in texts]
    assert S.fingerprint("a b c d e f g " * 50, step=7) == S.fingerprint("a b c d e f g " * 50)


def clusters(seed=1, n=400):
    rnd = np.random.default_rng(seed)
    flip = lambda v, k: v ^ int(sum(1 << int(b) for b in rnd.choice(64, k, replace=False)))
    out = []
    for _ in range(n // 8):
        v = int(rnd.integers(0, 1 << 63))
        out += [v, flip(v, 1), flip(v, 2), flip(v, 3), flip(v, 4), flip(flip(v, 3), 3)]
    v = 0x0F0F0F0F0F0F0F0F
    for _ in range(n):  # a dense cluster that shares most parts
        v = flip(0x0F0F0F0F0F0F0F0F, int(rnd.integers(0, 4)))
        out.append(v)
    return list(dict.fromkeys(out))


def components_of(spark, fps):
    nodes = spark.createDataFrame([(int(np.uint64(f).view(np.int64)), i) for i, f in enumerate(fps)], "fp long, rep long")
    got = {r["node"]: r["component"] for r in S.components(S.links(nodes)).collect()}
    return [got.get(i, i) for i in range(len(fps))]


def test_no_link_is_lost(spark):
    fps = clusters()
    assert components_of(spark, fps) == brute_components(fps)


def test_full_keys_are_filed_again(spark, monkeypatch):
    monkeypatch.setattr(S, "SPLIT_ROWS", 40)
    monkeypatch.setattr(S, "SMALL_GROUP", 6)
    fps = clusters(7)
    assert components_of(spark, fps) == brute_components(fps)


def test_refiled_keys_that_are_still_full_are_filed_once_more(spark, monkeypatch):
    monkeypatch.setattr(S, "SPLIT_ROWS", 6)
    rnd = np.random.default_rng(5)
    base = 0x123456789ABCDEF
    # All share three parts' bits, so that every first key and most of the next are full.
    fps = list(dict.fromkeys(base ^ (int(x) << 50) for x in rnd.integers(0, 1 << 14, 300)))
    rounds = []
    original = S._file_again
    monkeypatch.setattr(S, "durable", lambda df, f=S.durable: rounds.append(1) or f(df))
    assert original is S._file_again and components_of(spark, fps) == brute_components(fps)
    assert len(rounds) > 4


def test_hubs_are_joined_apart(spark, monkeypatch):
    from concordat import shared

    monkeypatch.setattr(shared, "LEAST_HOT_ROWS", 5)
    n = 60
    pairs = [(i, 0) for i in range(1, n)] + [(i + 1000, i) for i in range(1, n, 2)] + [(5000, 1001), (7001, 7000)]
    got = {r["node"]: r["component"] for r in S.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert set(got.values()) == {0, 7000} and got[5000] == 0 and len(got) == n - 1 + n // 2 + 2


def test_thresholds_sum_up_and_prefer_rare_values():
    counts = np.ones((S.PARTS, 1 << S.WIDTH))
    counts[0, 5] = 1e6
    units = S.thresholds(np.array([[5, 6]] + [[1, 1]] * 3), counts)
    assert (units.sum(axis=0) == S.LIMIT + 1).all() and units[0, 0] == 0 and units[0, 1] >= 1


def test_parts_group_correlated_bits():
    rnd = np.random.default_rng(2)
    bits = rnd.integers(0, 2, (4000, 64))
    bits[:, 40:44] = bits[:, :1]
    parts = S.choose_parts((bits.T @ bits).astype(float), 4000)
    assert sorted(b for p in parts for b in p) == list(range(64)) and {len(p) for p in parts} == {16}
    assert any({0, 40, 41, 42, 43} <= set(p) for p in parts)


def test_long_chain_is_one_component(spark):
    n = 120
    edges = spark.createDataFrame([(i + 1, i) for i in range(n)] + [(900, 500)], "u long, v long").withColumn("r", F.rand(3)).orderBy("r").select("u", "v")
    got = {r["node"]: r["component"] for r in S.components(edges).collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {900: 500}


def documents(spark):
    base = " ".join(f"word{i}" for i in range(300))
    rows = [(7, base), (3, base.upper()), (5, base + " tail"), (9, None), (8, ""), (None, base), (None, "nobody else " * 9), (20, " ".join(f"other{i}" for i in range(300))), (20, " ".join(f"other{i}" for i in range(300))), (21, "a b")]
    return spark.createDataFrame([(i, t, "c", "c", "s") for i, t in rows], DOCS), rows


def test_documents(spark):
    df, rows = documents(spark)
    got = [(r["doc_id"], r["fp"], r["component_id"]) for r in S.near_duplicates(df).collect()]
    assert len(got) == len(rows)
    by = {i: c for i, _, c in got if i is not None}
    assert by[7] == by[3] == 3 and by[9] == by[8] == 8 and by[20] == 20 and by[21] == 21
    assert sorted((c for i, _, c in got if i is None), key=repr) == [3, None]
    assert S.near_duplicates(df.limit(0)).count() == 0
    hexes = {r["doc_id"]: r["h"] for r in S.near_duplicates(df).select("doc_id", S.fingerprint_hex(F.col("fp")).alias("h")).collect()}
    assert all(hexes[i] == f"{brute_fingerprint(t):016x}" for i, t in rows if i is not None)


def test_one_of_each_stays(spark):
    df, _ = documents(spark)
    kept = S.keep_one_each(df)
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert kept.columns == df.columns and ids == ([3, 5, 8, 20, 21] if 5 in ids else [3, 8, 20, 21])


def kept_rows(spark, rows):
    df = spark.createDataFrame([(i, t, "c", "c", s) for i, t, s in rows], DOCS).repartition(3)
    out = S.keep_one_of_each(df)
    assert out.columns == df.columns
    return sorted(((r["doc_id"], r["text"], r["source"]) for r in out.collect()), key=repr)


def test_rows_without_id_stay_unless_linked(spark):
    a, b, c = (" ".join(f"{w}{i}" for i in range(300)) for w in "abc")
    rows = [(4, a, "s"), (None, a, "s"), (None, a.upper(), "t"), (None, b, "s"), (None, b, "s"), (None, b.upper(), "s"), (None, None, "s"), (None, " ", "s"), (6, c, None), (6, c, None)]
    got = kept_rows(spark, rows)
    assert sorted(((i, (t or "").lower().strip()) for i, t, _ in got), key=repr) == sorted([(4, a), (6, c), (None, ""), (None, b)], key=repr)
    assert got == kept_rows(spark, rows[::-1])


def test_texts_that_share_an_id_are_kept_apart(spark):
    a, b, c = (" ".join(f"{w}{i}" for i in range(300)) for w in "abc")
    assert {(i, t) for i, t, _ in kept_rows(spark, [(20, a, "s"), (20, b, "s"), (20, b.upper(), "t"), (20, c, "s"), (3, a, "s")])} - {(20, b), (20, b.upper())} == {(3, a), (20, c)}
    assert len(kept_rows(spark, [(20, a, "s"), (20, b, "s"), (20, b.upper(), "t"), (20, c, "s"), (3, a, "s")])) == 3


def test_unsettled_components_are_an_error(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)], "u long, v long")
    with pytest.raises(RuntimeError, match="not settled"):
        S.components(edges, max_rounds=2)
