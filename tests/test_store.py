import threading

import pytest
from pyspark.sql import functions as F

from concordat.sources import store as S
from concordat.sources.store import Conflict, Store

DOCS = "document_id string, total_pages int"
FACTS = "fact_id string, document_id string, pos long, v string"
RELATIONS = "relationship_id string, a_document_id string, b_document_id string"


def save(spark, store, name, docs, **kw):
    d = spark.createDataFrame([(x, 1) for x in docs], DOCS)
    f = spark.createDataFrame([(f"f-{x}", x, k, f"{name}{k}") for x in docs for k in (1, 2)], FACTS)
    r = spark.createDataFrame([(f"{a}{b}", a, b) for a in docs for b in docs if a < b], RELATIONS)
    return store.save(name, d, f, r, **kw).first()


def seen(store, name, version=None):
    got = store.load(name, version)
    if got is None:
        return None
    facts = sorted((r["document_id"], r["v"]) for r in got["facts"].collect())
    return sorted(r["document_id"] for r in got["documents"].collect()), facts, sorted(r["relationship_id"] for r in got["relationships"].collect())


def test_versions_and_snapshots(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    assert store.load("x") is None and store.begin() == 0 and store.owners() is None
    one = save(spark, store, "one", "abc")
    assert (one["version"], one["n_documents"], one["n_facts"], one["n_relationships"]) == (1, 3, 3, 3)
    two = save(spark, store, "two", "bd")
    assert two["version"] == 2
    assert seen(store, "one") == (["a", "b", "c"], [("a", "one2"), ("b", "two2"), ("c", "one2")], ["ac"])
    assert seen(store, "one", 1) == (["a", "b", "c"], [("a", "one2"), ("b", "one2"), ("c", "one2")], ["ab", "ac", "bc"])
    assert seen(store, "two", 1) is None and seen(store, "two")[0] == ["b", "d"]


def test_of_two_writers_one_wins_and_the_other_comes_after(spark, tmp_path, monkeypatch):
    store = Store(spark, f"{tmp_path}/s")
    save(spark, store, "zero", "x")
    gate, tried, put = threading.Barrier(2), [], S.Log.put

    def both_at_once(self, name, content):
        tried.append((content["analysis_id"], content["version"]))
        if len(tried) <= 2:
            gate.wait(60)
        return put(self, name, content)

    monkeypatch.setattr(S.Log, "put", both_at_once)
    versions = {}
    writers = [threading.Thread(target=lambda n=n: versions.update({n: save(spark, Store(spark, f"{tmp_path}/s"), n, "ab")["version"]})) for n in ("left", "right")]
    for w in writers:
        w.start()
    for w in writers:
        w.join(120)
    assert sorted(versions.values()) == [2, 3] and sorted(v for _, v in tried) == [2, 2, 3]
    last = max(versions, key=versions.get)
    assert {r["analysis_id"] for r in store.owners().filter("document_id <> 'x'").collect()} == {last}


def test_conflicts_are_told_to_a_writer_that_must_not_come_after(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    since = store.begin()
    save(spark, store, "first", "ab")
    with pytest.raises(Conflict):
        save(spark, store, "second", "bc", since=since, retry=False)
    assert seen(store, "second") is None and [r["analysis_id"] for r in store.analyses().collect()] == ["first"]
    assert save(spark, store, "apart", "cd", since=since, retry=False)["version"] == 2  # no document in common
    store.compact()
    with pytest.raises(Conflict):
        save(spark, store, "third", "d", since=since, retry=False)
    assert save(spark, store, "second", "bc", since=store.begin(), retry=False)["version"] == 3


def test_compaction_keeps_what_holds(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    for name, docs in (("one", "abc"), ("two", "bd"), ("three", "bcd")):
        save(spark, store, name, docs)
    before = {n: seen(store, n) for n in ("one", "two", "three")}
    assert store.compact() == 3 and store.compact() == 3
    at = store.snapshot()
    assert at.runs == [] and at.base_version == 3 and {n: seen(store, n) for n in before} == before
    assert seen(store, "one", 1)[2] == ["ab", "ac", "bc"]  # earlier versions are still there
    assert spark.read.parquet(f"{at.base}/facts").count() == 4
    save(spark, store, "four", "a")
    assert [r["analysis_id"] for r in store.snapshot().runs] == ["four"]
    assert seen(store, "one") == (["a", "b", "c"], [("a", "four2"), ("b", "three2"), ("c", "three2")], [])
    assert store.vacuum() == 3 and not list((tmp_path / "s" / "facts").glob("run=r-one*"))
    assert seen(store, "three") == before["three"] and seen(store, "four")[0] == ["a"]
    store.compact()
    assert store.vacuum() == 1 and seen(store, "four")[1] == [("a", "four2")] and store.analyses().count() == 4


def test_a_commit_that_was_not_written_is_none(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    with pytest.raises(Exception, match="broken"):
        store.save("bad", spark.createDataFrame([("a", 1)], DOCS), spark.createDataFrame([], FACTS), spark.createDataFrame([("r", "a", "b")], RELATIONS).withColumn("x", F.raise_error(F.lit("broken")).cast("string")))
    assert store.load("bad") is None and store.begin() == 0
    assert store.log.put("v-x", {"a": 1}) and not store.log.put("v-x", {"a": 2}) and store.log.read(["v-x"]) == {"v-x": {"a": 1}}


TEXTS = "fact_id string, document_id string, pos long, entity string, metric string, value_raw string, supporting_text string, epistemic_status string"
LINKS = "relationship_id string, relationship_type string, explanation string, a_document_id string, b_document_id string, a_fact_id string, b_fact_id string"


def test_search_by_trigrams_is_a_search_of_all_texts(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    names = ["Acme Ltd", "ÄCME", "Bolt", "Zürich Re", "acme", "", None]
    facts = [(f"f{i}", f"d{i % 3}", i, names[i % 7], "Revenue Growth", f"{i} crore", "It ROSE\nfast" if i % 2 else None, "reported" if i % 3 else "target") for i in range(40)]
    links = [(f"r{i}", "CONTRADICTS" if i % 2 else "CORROBORATES", f"Values of {names[i % 7]} differ", f"d{i % 3}", f"d{(i + 1) % 3}", f"f{i}", f"f{i + 1}") for i in range(30)]
    docs = spark.createDataFrame([(f"d{k}", 1) for k in range(3)], DOCS)
    store.save("one", docs, spark.createDataFrame(facts, TEXTS), spark.createDataFrame(links, LINKS))
    store.save("two", docs.filter("document_id = 'd1'"), spark.createDataFrame([f for f in facts if f[1] == "d1"][:4], TEXTS), spark.createDataFrame([], LINKS))

    def all_at(version):
        at = store.snapshot(version)
        live = store._read("facts", at).join(store.owners(version), ["document_id", "analysis_id"], "left_semi")
        return live

    for version in (1, 2):
        live = all_at(version)
        for q in ("acme", "ÄCME", "e\nf", "crore", "9 c", "ro", "", "no such text", "Ltd", "growth", "zürich", "LtdRev", "se\nfast"):
            for status in (None, "reported"):
                want = sorted(r["fact_id"] for r in S.search_facts(live, q, status).collect())
                assert sorted(r["fact_id"] for r in store.search_facts(q, status, version).collect()) == want, q
    for q in ("differ", "bolt", "Growth", "of ac", "x", "39 crore", "nothing of it"):
        held = [r["relationship_id"] for r in store.search_relations(q, "CONTRADICTS", 1).collect()]
        assert sorted(held) == sorted(r["relationship_id"] for r in S.search_relations(spark.createDataFrame(links, LINKS), spark.createDataFrame(facts, TEXTS), q, "CONTRADICTS").collect()), q
    store.compact()
    store.vacuum()
    assert sorted(r["fact_id"] for r in store.search_facts("acme").collect()) == sorted(r["fact_id"] for r in S.search_facts(all_at(2), "acme").collect())


def test_a_search_reads_the_folders_of_its_own_trigrams_only(spark, tmp_path):
    from concordat.sources import search

    texts = spark.range(2000).select(F.col("id").cast("string").alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("t"))
    search.write_index(texts, ["id"], "t", f"{tmp_path}/index")
    index = spark.read.parquet(f"{tmp_path}/index")
    wanted = texts.filter("id = '77'").first()["t"][10:20]
    found = search.candidates(index, wanted, ["id"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.split("\n") if "FileScan parquet" in x)
    assert "PartitionFilters: [isnotnull(bucket" in scan or "PartitionFilters: [bucket" in scan and "IN" in scan.upper()
    files = {f for f in found.inputFiles()}
    assert [r["id"] for r in search.search(texts, index, wanted, ["id"], F.col("t")).collect()] == ["77"]
    assert search.candidates(index, "zz", ["id"]) is None and search.candidates(index, "zzzz", ["id"]).count() == 0 and files
