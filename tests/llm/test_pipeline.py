import random

import corpus_pipeline as P
from concordat.llm import simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string"


def prose(rnd, n=120):
    return " ".join(f"w{rnd.randrange(5000)}" + rnd.choice(["", "", ".", ","]) for _ in range(n))


def corpus(spark, folder):
    rnd = random.Random(6)
    good = [prose(rnd) for _ in range(1200)]
    junk = [" ".join(w + rnd.choice(["$$$", "%%%"]) for w in prose(rnd).split()) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(good + junk)]
    copies = [(5000 + i, good[i]) for i in range(40)] + [(6000 + i, good[50].upper()) for i in range(200)]
    docs = [(i, t, "en", "hot" if i % 3 else f"s{i % 5}", len(t), "clash") for i, t in rows + copies] + [(9000, "", None, None, 0, None), (9001, None, None, None, None, None)]
    spark.createDataFrame(docs, DOCS).repartition(6).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 1200), 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return dict(enumerate(good))


def test_stages_in_turn(spark, tmp_path):
    good = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "near_dedup":
            ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
            assert set(good) <= ids and not ids & set(range(1200, 1350)) and 9000 not in ids
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} == set(good)
    assert len({simhash.fingerprint(t) for t in good.values()}) == len(good)


def test_run_places_every_word(spark, tmp_path):
    good = corpus(spark, tmp_path)
    words: dict[int, int] = {}
    for r in P.run(spark, str(tmp_path)).collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + r["n_words"]
    assert words == {i: len(t.split()) for i, t in good.items()}


def test_classifier_stage_rejects_what_the_rules_let_pass(spark, tmp_path):
    corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    passed = docs.filter("doc_id < 1200 OR doc_id BETWEEN 1200 AND 1204")  # of the junk, five documents are left
    gone = docs.filter("doc_id > 1204 AND doc_id < 1350")
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    unlabelled = labels.filter("doc_id NOT BETWEEN 1200 AND 1204")
    (tmp_path / "few").mkdir()
    passed.unionByName(gone).write.parquet(f"{tmp_path}/few/documents.parquet")
    unlabelled.write.parquet(f"{tmp_path}/few/labels.parquet")
    kept = {r["doc_id"] for r in P.quality_classifier_stage(spark, passed, f"{tmp_path}/few").select("doc_id").collect()}
    assert kept == set(range(1200))


def words_by_text(spark, folder):
    """Rows that the pipeline keeps, by id, with their words."""
    out = {}
    for r in P.run(spark, str(folder)).collect():
        out[r["doc_id"]] = out.get(r["doc_id"], 0) + r["n_words"]
    return out


def test_null_and_repeated_ids(spark, tmp_path):
    good = corpus(spark, tmp_path)
    rnd = random.Random(8)
    lone, other, third = prose(rnd, 90), prose(rnd, 80), prose(rnd, 70)
    rows = [(None, lone, "en", "s", 0, ""), (None, lone, "en", "s", 0, ""), (None, good[3], "en", "s", 0, ""), (7, other, "en", "s", 0, ""), (7, other, "en", "s", 0, ""), (3001, third, "en", None, 0, ""), (3001, third, "en", None, 0, "")]
    more = spark.createDataFrame(rows, DOCS)
    (tmp_path / "more").mkdir()
    spark.read.parquet(f"{tmp_path}/documents.parquet").unionByName(more).write.parquet(f"{tmp_path}/more/documents.parquet")
    spark.read.parquet(f"{tmp_path}/labels.parquet").write.parquet(f"{tmp_path}/more/labels.parquet")
    want = {i: len(t.split()) for i, t in good.items()}
    want[7] += 80  # a different text under an id that is there already
    assert words_by_text(spark, tmp_path / "more") == want | {None: 90, 3001: 70}


def test_empty_tables(spark, tmp_path):
    good = corpus(spark, tmp_path)
    docs, labels = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))
    for name, d, x in (("a", docs.limit(0), labels), ("b", docs.filter("doc_id < 40"), labels.limit(0)), ("c", docs.limit(0), labels.limit(0))):
        (tmp_path / name).mkdir()
        d.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        x.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        assert words_by_text(spark, tmp_path / name) == ({i: len(good[i].split()) for i in range(40)} if name == "b" else {})


def test_nothing_is_left_of_the_stages(spark, tmp_path):
    import os

    corpus(spark, tmp_path)
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    P.run(spark, str(tmp_path))
    new = [f for f in set(os.listdir(folder)) - before if not os.path.isdir(f"{folder}/{f}") or f.startswith(("table-", "pipeline-"))]
    assert len(new) == 1 and os.listdir(f"{folder}/{new[0]}") == ["packing"]
