import random
import re
from collections import Counter
from itertools import permutations

from concordat.llm import filter_audit as A

DOCS = "doc_id long, text string, source string, n long, mask string, label int"
LABELS = "doc_id long, quality int, toxic int, part string"


def naive(docs, labels):
    first = {}
    for i, t, *_ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good = {i for i, q, _, _ in labels if q == 1 and i is not None}
    bad = {i for i, _, t, _ in labels if t == 1 and i is not None}
    seen = []
    for i, t, s, *_ in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = set()
        fails |= {"A"} if len(w) < 200 else set()
        fails |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        fails |= {"E"} if i is not None and i > first[t] else set()
        seen.append((s or "", fails, i in good, i in bad))
    out = {}
    for part in {s for s, *_ in seen}:
        own = [x for x in seen if x[0] == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                redundant = sum(f in x[1] for x in own) - len(gone)
                out[part, order, step] = [len(left), len(gone), redundant, sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def run(spark, docs, labels):
    rows = A.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    out = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in rows}
    assert len(out) == len(rows)
    return out


def corpus(seed=1, n=300):
    rnd = random.Random(seed)
    texts = [None, "", " \t\n", "A" * 50, "one # two", " word", "wörd joined words " * 210, " ".join(map(str, range(250))), "é" * 100 + "AB", "same " * 300, "\x0b\x0c\r" * 5 + "x"]
    texts += [" ".join(f"{'W' if rnd.random() < 0.3 else 'w'}{rnd.randrange(400)}" for _ in range(rnd.randrange(150, 260))) for _ in range(25)]
    docs = [(rnd.choice([None, *range(200)]), rnd.choice(texts), rnd.choice([None, "", "a", "b", "c|d"]), 1, "x", 2) for _ in range(n)]
    labels = [(rnd.choice([None, *range(200)]), rnd.choice([None, 0, 1]), rnd.choice([None, 0, 1]), "p") for _ in range(150)]
    return docs, labels


def test_audit_matches_filters_applied_one_by_one(spark):
    docs, labels = corpus()
    assert run(spark, docs, labels) == naive(docs, labels)


def test_copies_ties_and_null_ids(spark):
    docs = [(5, "x", "a", 1, "", 0), (5, "x", "b", 1, "", 0), (5, "x", "a", 1, "", 0), (9, "x", "a", 1, "", 0), (None, "x", "a", 1, "", 0), (None, "y", "a", 1, "", 0), (7, "y", "a", 1, "", 0), (8, None, "a", 1, "", 0), (3, "", "a", 1, "", 0)]
    labels = [(9, 1, 1, ""), (9, 0, None, ""), (8, 1, 0, "")]
    assert run(spark, docs, labels) == naive(docs, labels)


def test_empty_tables(spark):
    assert run(spark, [], []) == {}
    got = run(spark, [(1, "x", "s", 1, "", 0)], [])
    assert len(got) == 600 and got["s", "ABCDE", 1] == [0, 1, 0, 1, 0, 0, 120] and got["s", "BACDE", 1] == [1, 0, 0, 0, 0, 0, 0]


def test_many_parts_and_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(A, "HELD_PARTS", 3)
    docs = [(i, f"t{i % 7} #", f"s{i % 40}", 1, "", 0) for i in range(120)]
    assert run(spark, docs, []) == naive(docs, [])
    text = ("ab cd\x0bef " * 400_000 + "x" * 3_000_000 + " end").encode()
    assert A._word_counts(text) == (len(text.split()), len(set(text.split())))


def test_table_of_first_failures():
    table = A.first_failures()
    assert table.shape == (32, 120) and set(table[0]) == {5} and set(table[31]) == {0}
    assert table[0b10010][A.ORDERS.index("ACEBD")] == 2 and table[0b00010][A.ORDERS.index("ACEBD")] == 3


def test_counts_beyond_53_bits_stay_exact(spark):
    rows = spark.createDataFrame([("p", 1, 1, (1 << 55) + 1), ("p", 1, 0, 3)], "part string, mask int, label int, n long").coalesce(1)
    got = [r for r in rows.mapInArrow(A._count, A.COUNTED).collect() if r["filter_order"] == "ABCDE" and r["step"] == 1]
    assert got[0]["removed"] == (1 << 55) + 4 and got[0]["good_lost"] == (1 << 55) + 1
