from pyspark.sql import functions as F

from concordat.streaming import arrivals

CLAIM = "pos long, fact_id string, document_id string, page_number int, entity string, metric string, value_raw string, value_numeric double, unit string, period_label string, scope string, geography string, epistemic_status string, data_vintage string, supporting_text string, at long"
HOUR = 3600


def row(i, value, metric="Revenue", period="FY 2023-24", text="t", hour=0, pos=None):
    return (i if pos is None else pos, f"f{i}", "d", 1, "Acme", metric, value, None, None, period, None, None, "reported", None, text, 1_700_000_000 + hour * HOUR)


class Feed:
    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder

    def put(self, *rows):
        df = self.spark.createDataFrame(list(rows), CLAIM).withColumn("arrived", F.timestamp_seconds("at")).drop("at").coalesce(1)
        df.write.mode("append").parquet(f"{self.folder}/in")
        stream = self.spark.readStream.schema(df.schema).parquet(f"{self.folder}/in")
        self.query = arrivals.run(stream, f"{self.folder}/facts", f"{self.folder}/relations", f"{self.folder}/check", delay="1 hour", keep="10 hours")
        assert self.query.awaitTermination(120)
        return self

    def relations(self):
        rows = self.spark.read.parquet(f"{self.folder}/relations").collect()
        assert len({r["relationship_id"] for r in rows}) == len(rows)
        return {(r["a_fact_id"], r["b_fact_id"]): r["relationship_type"] for r in rows}


def test_each_batch_meets_what_is_kept_and_reads_no_table(spark, tmp_path, monkeypatch):
    feed = Feed(spark, tmp_path).put(row(1, "₹5 crore"), row(1, "₹5 crore"), row(9, "₹7 crore", metric="Other"), row(8, "₹7 crore", period="FY24", pos=0))
    assert feed.relations() == {("f8", "f1"): "UNRESOLVED"}
    gone = tmp_path / "gone"
    for name in ("facts", "relations"):  # nothing of what was written is there when the second batch runs
        (tmp_path / name).rename(f"{gone}-{name}")
    # Claims that repeat, that differ, of another period, in percent, with a comparison of times, and too late.
    feed.put(row(1, "₹5 crore"), row(2, "₹50 million"), row(3, "₹9 crore"), row(4, "₹1 crore", period="FY 2022-23"), row(5, "5%"), row(6, "₹2 crore", period="FY 2021-22", text="up from last year"))
    want = {("f1", "f2"): "CORROBORATES", ("f1", "f3"): "CONTRADICTS", ("f2", "f3"): "CONTRADICTS"}
    want |= {(a, b): "UNRESOLVED" for a, b in [("f8", "f2"), ("f8", "f3"), ("f8", "f4"), ("f8", "f6"), ("f1", "f6"), ("f2", "f6"), ("f3", "f6"), ("f4", "f6")]}
    assert feed.relations() == want
    assert sorted(r["fact_id"] for r in spark.read.parquet(f"{tmp_path}/facts").collect()) == ["f2", "f3", "f4", "f5", "f6"]
    feed.put(row(20, "₹6 crore", hour=5))  # moves the watermark to four hours
    feed.put(row(21, "₹6 crore", hour=2), row(22, "₹6 crore", hour=5))  # the first is later than the delay
    got = feed.relations()
    assert got["f20", "f22"] == "CORROBORATES" and got["f1", "f20"] == "CONTRADICTS" and not any("f21" in k for k in got)
    # After ten hours the first facts are forgotten, and those of the fifth hour are not.
    feed.put(row(23, "₹6 crore", hour=13))
    feed.put(row(24, "₹6 crore", hour=13))
    got = feed.relations()
    assert ("f20", "f24") in got and ("f23", "f24") in got and ("f1", "f24") not in got
    feed.put(row(24, "₹6 crore", hour=13), row(1, "₹5 crore", hour=13))  # f1 is new again, f24 a repetition
    assert ("f24", "f1") in feed.relations()


def test_a_stream_gives_what_one_batch_gives(spark, tmp_path):
    texts = ("plain", "was 3 in 2001 and", "it rose", "from 1 to 2", "was 1 in 2001 and 2 in 2002")
    rows = [row(i, v, period=p, text=t) for i, (v, p, t) in enumerate((v, p, t) for v in ("₹1 crore", "5%") for p in ("FY 2023-24", "FY 2022-23", "FY24") for t in texts)]
    feed = Feed(spark, tmp_path)
    for k in range(0, len(rows), 11):
        feed.put(*rows[k : k + 11])
    whole = arrivals.normalize_facts(spark.createDataFrame(rows, CLAIM).drop("at"))
    want = {(r["a_fact_id"], r["b_fact_id"]): r["relationship_type"] for r in arrivals.relate_batch(whole, whole.limit(0)).collect()}
    assert feed.relations() == want and len(want) > 50
