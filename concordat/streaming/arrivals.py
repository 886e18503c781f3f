"""Claims as they arrive, each related to those before it, which are kept as state by entity and metric.

Arriving claims are normalised and grouped by entity and metric. A group's earlier facts are its state, on
the executors' disks and in the checkpoint, so that a batch reads no table: each arriving fact meets the
facts that are kept under its own key, then the others of its batch. What can be a pair by period and
units is given on and decided by the same expressions as in a batch job. A fact is forgotten by a timer
once the watermark has passed its arrival by ``keep``.

Defined results: a claim whose fact_id is kept already is a repetition and left out; claims that are later
than the watermark's ``delay`` are dropped; of facts that arrive together the smaller (pos, fact_id)
comes first, and a null pos before all; facts without an entity or metric are stored and meet none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ..operators.facts import CARRIED, OPENS_TIME, SAYS_TIME, SAYS_WAS, normalize_facts, pairs_by_period
from ..operators.relations import classify, compare, surfaces
from ..shared import durable
from ..shipping import ship

#: What is kept of a fact: its place, its period (null: none), whether it meets facts of other periods as the
#: first or second of a pair, its kind of unit, when it is forgotten (milliseconds), and the whole fact as JSON.
KEPT = "pos long, period string, opens boolean, joins boolean, unit string, until long, fact string"
PAIRED = "a string, b string"
#: Timers are set for the ends of spans of so many milliseconds, so that a group has few of them.
SPAN_MS = 60_000
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def relate_to(arrived: DataFrame, stored: DataFrame) -> DataFrame:
    """Relations between facts that have arrived and stored ones, both normalised; the stored come first."""
    return classify(compare(pairs_by_period(stored, arrived, F.col("a_fact_id") != F.col("b_fact_id"), surfaces())))


def relate_batch(arrived: DataFrame, stored: DataFrame) -> DataFrame:
    """Relations of a batch with stored facts, and among its own, of which the smaller (pos, fact_id) comes first."""
    first = F.struct("a_pos", "a_fact_id") < F.struct("b_pos", "b_fact_id")
    return relate_to(arrived, stored).unionByName(relate_to(arrived, arrived).filter(first))


def _meets(a: tuple, b: tuple) -> bool:
    """Whether two kept facts can be a pair that surfaces, the first one being ``a``."""
    (_, period, opens, _, unit, *_), (_, other, _, joins, kind, *_) = a, b
    return ({unit, kind} != {"money", "percent"}) and (opens or joins or period == other)


class Meetings(StatefulProcessor):
    """Pairs of one entity and metric: of each new fact with those kept, and with the others of its batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.kept = handle, handle.getMapState("facts", "fact_id string", KEPT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[str, tuple] = {}
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                if r.fact_id not in new and not self.kept.containsKey((r.fact_id,)):
                    pos = None if pd.isna(r.pos) else int(r.pos)
                    new[r.fact_id] = (pos, r.period if isinstance(r.period, str) else None, bool(r.opens), bool(r.joins), r.unit, int(r.until), r.fact)
        able = bool(key[0]) and bool(key[1])
        out = [(v[-1], None) for v in new.values()]
        if able:
            for _, then in self.kept.iterator():
                out += [(then[-1], now[-1]) for now in new.values() if _meets(then, now)]
                if len(out) >= 10_000:
                    yield pd.DataFrame(out, columns=["a", "b"])
                    out = []
            order = sorted(new.items(), key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
            for k, (_, one) in enumerate(order):
                out += [(one[-1], other[-1]) for _, other in order[k + 1 :] if _meets(one, other)]
                if len(out) >= 10_000:
                    yield pd.DataFrame(out, columns=["a", "b"])
                    out = []
        timers = set()
        for fact_id, v in new.items():
            self.kept.updateValue((fact_id,), v)
            timers.add(-(-v[5] // SPAN_MS) * SPAN_MS)
        for at in timers - {t[0] if isinstance(t, tuple) else t for t in self.handle.listTimers()}:
            self.handle.registerTimer(at)
        yield pd.DataFrame(out, columns=["a", "b"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        for k in [k for k, v in self.kept.iterator() if v[5] <= now]:
            self.kept.removeKey(k)
        yield pd.DataFrame({"a": [], "b": []}, dtype="object")

    def close(self) -> None:
        pass


def _keys(facts: DataFrame, time: str, keep: str) -> DataFrame:
    """Normalised facts as the rows that are grouped: key, ``KEPT`` and fact_id."""
    bounded = F.col("norm_start").isNotNull() & F.col("norm_end").isNotNull()
    says = lambda bit: F.col("time_marks").bitwiseAND(bit) != 0
    years = F.shiftright("time_marks", 3)
    some = lambda c: F.coalesce(c, F.lit(True))
    until = F.unix_millis(F.col(time) + F.expr(f"INTERVAL {keep}"))
    return facts.select(
        "ekey",
        "mkey",
        "fact_id",
        "pos",
        F.when(bounded, F.concat_ws("/", "norm_start", "norm_end")).alias("period"),
        some(~bounded | says(SAYS_TIME) | says(OPENS_TIME) | (says(SAYS_WAS) & (years >= 1))).alias("opens"),
        some(~bounded | says(SAYS_TIME) | (years >= 2)).alias("joins"),
        F.col("unit_kind").alias("unit"),
        until.alias("until"),
        F.to_json(F.struct(*facts.columns), TIMES).alias("fact"),
        F.col(time).alias("__time"),
    )


def meetings(stream: DataFrame, time: str = "arrived", delay: str = "1 hour", keep: str = "365 days") -> tuple[DataFrame, StructType]:
    """A stream of ``PAIRED`` (new facts have no b) from a stream of claims, and the schema of the facts in it."""
    facts = normalize_facts(stream.withWatermark(time, delay))
    grouped = _keys(facts, time, keep).groupBy("ekey", "mkey")
    ship(stream.sparkSession)
    return grouped.transformWithStateInPandas(statefulProcessor=Meetings(), outputStructType=PAIRED, outputMode="append", timeMode="EventTime"), facts.schema


def relations_of(paired: DataFrame, schema: StructType) -> DataFrame:
    """The relations of a batch of ``PAIRED``."""
    side = lambda c: F.from_json(c, schema, TIMES)
    both = paired.filter("b IS NOT NULL").select(side("a").alias("x"), side("b").alias("y"))
    pairs = both.select(*(F.col(f"{s}.{c}").alias(p + c) for s, p in (("x", "a_"), ("y", "b_")) for c in CARRIED))
    one_key: Column = F.col("a_fact_id") != F.col("b_fact_id")
    return classify(compare(pairs.filter(one_key & surfaces())))


def run(stream: DataFrame, facts_path: str, relations_path: str, checkpoint: str, time: str = "arrived", delay: str = "1 hour", keep: str = "365 days", **trigger) -> StreamingQuery:
    """Appends each batch's facts and relations; a batch that is run again writes the same partition again.

    The tables are only written. What a batch needs of earlier ones is the query's own state.
    """
    spark: SparkSession = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)  # the one that keeps maps and timers
    paired, schema = meetings(stream, time, delay, keep)

    def each(batch: DataFrame, batch_id: int) -> None:
        held = durable(batch)  # the state is read and written once for a batch
        facts = held.filter("b IS NULL").select(F.from_json("a", schema, TIMES).alias("f")).select("f.*")
        write = lambda df, path: df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)
        write(relations_of(held, schema), relations_path)
        write(facts, facts_path)

    return paired.writeStream.foreachBatch(each).outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
