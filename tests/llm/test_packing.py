import random
import re
from collections import Counter

from pyspark.sql import functions as F

from concordat.llm import packing as P

DOCS = "doc_id long, text string, source string, bin_id string, n_words string, size string"


def naive(pieces, capacity):
    """The bin of least sufficient residual (ties: the oldest) without a conflict, found by looking at all."""
    bins, out = [], []
    for size, source, cluster in pieces:
        able = [(b["left"], i) for i, b in enumerate(bins) if b["left"] >= size and source not in b["s"] and cluster not in b["c"]]
        i = min(able)[1] if able else len(bins)
        if not able:
            bins.append({"left": capacity, "s": set(), "c": set()})
        bins[i]["left"] -= size
        bins[i]["s"] |= {source} - {-1, None}
        bins[i]["c"] |= {cluster} - {-1, None}
        out.append(i)
    return out


def test_best_fit_matches_naive_search():
    rnd = random.Random(3)
    for _ in range(60):
        pieces = sorted(((rnd.randrange(0, 60), rnd.randrange(-1, 5), rnd.randrange(-1, 9)) for _ in range(rnd.randrange(0, 80))), reverse=True)
        assert P.best_fit(pieces, 60) == naive(pieces, 60)


def docs(spark, n=400):
    rnd = random.Random(5)
    rows = [(i, " ".join(["w" + str(i % 50)] * rnd.choice([0, 1, 3, 20, 64, 65, 200])), None if i % 17 == 0 else "hot" if i % 3 == 0 else f"s{i % 7}", "c", "c", "c") for i in range(n)]
    rows += [(None, None, None, "c", "c", "c"), (None, "a b", "s1", "c", "c", "c"), (5, "again", "s1", "c", "c", "c"), (5, "AGAIN ", "s2", "c", "c", "c")]
    rows += [(7000, "twice " * 150, "s1", "c", "c", "c")] * 2 + [(7001, "thrice " * 130, None, "c", "c", "c")] * 3 + [(None, "", None, "c", "c", "c")] * 5
    return spark.createDataFrame(rows, DOCS), rows


def members_of(packed):
    bins = {}
    for r in packed:
        bins.setdefault(r["bin_id"], []).append(r)
        assert r["start"] == r["piece"] * 64
    return bins


def check_bins(packed, rows, capacity=64):
    """Every word of every row is placed once; no bin is over-full or holds two pieces that conflict."""
    want = Counter()
    for i, text, source, *_ in rows:
        n = len((text or "").split())
        for k in range(-(-n // capacity) or 1):
            want[i, k, min(capacity, n - k * capacity)] += 1
    assert Counter((r["doc_id"], r["piece"], r["n_words"]) for r in packed) == want
    once = Counter(i for i, *_ in rows)
    source = {i: s for i, _, s, *_ in rows if once[i] == 1 and i is not None}
    text = {i: " ".join((t or "").lower().split()) for i, t, *_ in rows if i is not None and i != 5}
    for members in members_of(packed).values():
        assert sum(r["n_words"] for r in members) <= capacity
        assert sorted(r["position"] for r in members) == list(range(len(members)))
        ids = [r["doc_id"] for r in members]
        named = [source[i] for i in ids if source.get(i)]
        assert len(named) == len(set(named))
        texts = [text[i] for i in ids if i in text]
        assert len(texts) == len(set(texts))


def test_packing_is_whole_and_without_conflicts(spark):
    table, rows = docs(spark)
    for shard_rows in (100, 10_000):
        check_bins(P.pack(table, capacity=64, shard_rows=shard_rows).collect(), rows)


def test_equal_long_rows_get_bins_of_their_own(spark):
    rows = [(1, "x " * 200, "s", "c", "c", "c")] * 3 + [(1, "x " * 200, "t", "c", "c", "c"), (None, "x " * 200, None, "c", "c", "c"), (None, "x " * 200, None, "c", "c", "c")]
    packed = P.pack(spark.createDataFrame(rows, DOCS), capacity=64).collect()
    full = Counter(r["bin_id"] for r in packed if r["n_words"] == 64)
    assert len(full) == 6 * 3 and set(full.values()) == {1}
    assert len({r["bin_id"] for r in packed if r["n_words"] == 8}) == 6  # one cluster: never together


def test_many_equal_rows_are_dealt_to_several_shards(spark, monkeypatch):
    monkeypatch.setattr(P, "MOST_COPIES", 10)
    table = spark.range(300).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b").alias("text"), F.lit(None).cast("string").alias("source"))
    packed = P.pack(table, capacity=64, shard_rows=40).collect()
    assert len(packed) == 300 and len({r["bin_id"] for r in packed}) == 300  # all of one cluster


def test_one_shard_is_the_naive_packing(spark):
    rnd = random.Random(11)
    rows = [(i, f"u{i} " + "w " * rnd.randrange(0, 90), rnd.choice(["a", "b", "c", None]), "", "", "") for i in range(150)]
    rows += [(1000 + i, rows[i][1].upper(), "d", "", "", "") for i in range(40)]
    pieces = []
    for i, t, s, *_ in rows:
        n = len(t.split())
        if n % 64 or not n:
            pieces.append((n % 64, i, s, " ".join(t.lower().split())))
    # Conflicts are by the text; ties in length are broken by the id, as every id is there once.
    pieces.sort(key=lambda p: (-p[0], p[1]))
    bins = naive([(n, s, t) for n, _, s, t in pieces], 64)
    want = {}
    for (n, i, *_), b in zip(pieces, bins):
        want.setdefault(b, set()).add((i, n))
    packed = P.pack(spark.createDataFrame(rows, DOCS), capacity=64).collect()
    got = {}
    for r in packed:
        if r["n_words"] < 64:
            got.setdefault(r["bin_id"], set()).add((r["doc_id"], r["n_words"]))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    check_bins(packed, rows)


def test_loose_bins_of_all_shards_are_packed_together(spark):
    rows = [(i, f"u{i} " + "w " * (i % 40), None, "", "", "") for i in range(1000)]
    packed = P.pack(spark.createDataFrame(rows, DOCS), capacity=64, shard_rows=10).collect()
    check_bins(packed, rows)
    n_bins = len({r["bin_id"] for r in packed})
    assert n_bins <= 1.15 * sum(len(t.split()) for _, t, *_ in rows) / 64 and any(re.match("b-", r["bin_id"]) for r in packed)


def test_result_does_not_depend_on_partitions(spark):
    table, _ = docs(spark)
    runs = [sorted(map(tuple, P.pack(t, 64, 100).collect()), key=repr) for t in (table.repartition(1), table.repartition(7, F.rand(1)))]
    assert runs[0] == runs[1]


def test_large_ids_stay_exact_beside_null_ones(spark):
    big = 2**62 + 1
    packed = P.pack(spark.createDataFrame([(big, "a", "s", "", "", ""), (None, "b", "s", "", "", "")], DOCS)).collect()
    assert {r["doc_id"] for r in packed} == {big, None}


def test_empty_table(spark):
    table, _ = docs(spark, 1)
    assert P.pack(table.limit(0)).count() == 0
