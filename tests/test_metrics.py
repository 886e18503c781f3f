from collections import Counter

import duckdb

from concordat.operators import metrics
from concordat.plans import oracle, registry


def test_overlaps_of_repeated_missing_and_turned_intervals(spark):
    rows = [
        (0, 1, 0, 10), (0, 1, 0, 10), (0, 1, 5, 700_000), (0, 2, 10, 20), (0, 3, 21, 21),
        (0, 4, None, 30), (0, 5, 3, None), (0, 6, 15, 12), (0, 7, 1_300_000, 1_200_000), (1, 1, 0, 5), (1, 8, 4, 4),
    ]
    want = Counter()
    for run, i, s, e in rows:
        for other, _, s2, e2 in rows:
            if run == other and None not in (s, e, s2, e2) and s2 <= e and e2 >= s:
                want[run, i] += 1
    found = metrics.interval_overlap(spark.createDataFrame(rows, "run_id int, request_id long, start_ms long, end_ms long")).collect()
    assert len(found) == len(want)
    assert {(r.run_id, r.request_id): r.n_active for r in found} == dict(want)


def test_overlaps_of_parts_of_milliseconds_are_those_of_the_sql(spark, tmp_path):
    """Starts are whole milliseconds, rounded to the nearest one, before 1970 too."""
    times = ["1969-12-31 23:59:57.9999", "1969-12-31 23:59:58.0001", "1969-12-31 23:59:59.9995", "1970-01-01 00:00:00.0005", "1970-01-01 00:00:00.001", "2024-01-01 00:00:00.0006", "2024-01-01 00:00:00.0014", "2024-01-01 00:00:00.0015"]
    rows = ", ".join(f"({3 * i}::BIGINT, TIMESTAMP '{t}', 1::BIGINT, 'view', 0::DOUBLE)" for i, t in enumerate(times))
    db = duckdb.connect()
    db.execute(f"CREATE TABLE events AS SELECT * FROM (VALUES {rows}) t(event_id, ts, user_id, event_type, value)")
    db.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    want = sorted(db.execute(oracle.oracle_sql()["interval_overlap"]).fetchall())
    assert sorted(map(tuple, registry.queries()["interval_overlap"](spark, str(tmp_path)).collect())) == want
