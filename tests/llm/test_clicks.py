"""The click stream against a plain pass over all copies."""

import calendar
import datetime
import hashlib
import math
import random
import zlib

from tidegraph.llm import clicks, common

SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"


def micros(at):
    return calendar.timegm(at.timetuple()) * 1_000_000 + at.microsecond


def plain(rows, batches=8, span=24, lateness=96):
    copies = []
    for r in rows:
        if r["arrived_at"] is None:
            continue
        arrived = micros(r["arrived_at"]) // 3_600_000_000
        for j in range(max(r["click_id"], 0) % 3 + 1 if r["click_id"] is not None else 1):
            c = zlib.crc32(f"{'' if r['click_id'] is None else r['click_id']}:{j}".encode())
            hour = arrived + 6 * j * (c % 10)
            value = "" if r["value"] is None else str(math.floor(100 * r["value"] + 0.5))
            parts = ["" if r["client_id"] is None else str(r["client_id"]), r["kind"] or "", value, "" if r["ts"] is None else str(micros(r["ts"])), r["props"] or "", str(c % 3)]
            copies.append((hour + c // 10 % 200, r["click_id"], hour, hashlib.sha256("|".join(parts).encode()).hexdigest()))
    if not copies:
        return []
    low, high = min(c[0] for c in copies), max(c[0] for c in copies)
    dealt = [[] for _ in range(batches)]
    for late, *copy in copies:
        dealt[(late - low) * batches // (high - low + 1)].append(tuple(copy))
    out, windows, most = [], {}, None
    for k, batch in enumerate(dealt):
        for click_id, hour, digest in sorted(batch, key=lambda c: (c[0] is None, c[0] or 0, *c[1:])):
            if k and most is not None and hour < most - lateness:
                continue
            w = windows.get(click_id)
            if w and hour <= w[0] + span:
                w[1] += 1
                if digest != w[4]:
                    w[2], w[3] = w[2] + 1, w[3] + zlib.crc32(digest.encode())
            else:
                if w:
                    out.append((click_id, w[0], k, *w[1:]))
                windows[click_id] = [hour, 0, 0, 0, digest]
        most = max([c[1] for c in batch] + ([most] if most is not None else []), default=None)
        for click_id in [i for i, w in windows.items() if k + 1 == batches or (most is not None and w[0] + span < most - lateness)]:
            w = windows.pop(click_id)
            out.append((click_id, w[0], k, *w[1:]))
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def test_against_a_plain_pass(spark):
    rng = random.Random(5)
    begin = datetime.datetime(1969, 11, 1)
    rows = []
    for k in range(900):
        at = begin + datetime.timedelta(hours=rng.randrange(1800), microseconds=rng.randrange(10**9))
        rows.append((rng.choice([k % 60, k, 7, None, -4]), at, at + datetime.timedelta(seconds=rng.randrange(90000)), rng.choice([None, 3, 4]), rng.choice([None, "view"]), rng.choice([None, 1.005, -2.5, 1e9]), rng.choice([None, "{}", "a|b"])))
    rows += rows[:120] + [(5, None, None, 1, "x", 1.0, ""), (6, None, begin, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS hash", "'y' AS bucket").repartition(5)
    want = plain([dict(zip([c.split()[0] for c in SCHEMA.split(", ")], r)) for r in rows])
    before = {k: spark.conf.get(k, None) for k in clicks.SETTINGS}
    got = clicks.windows(df, rows_per_bucket=100)
    assert got.columns == clicks.RESULT_COLUMNS
    assert ordered(got.collect()) == ordered(want)
    assert sum(r[3] for r in want) > 100 and sum(r[4] for r in want) > 20 and len({r[2] for r in want}) > 3
    assert before == {k: spark.conf.get(k, None) for k in clicks.SETTINGS}


def test_one_row_and_none(spark):
    row = (8, None, datetime.datetime(2024, 1, 1, 0, 30), 1, "a", 2.0, None)
    df = spark.createDataFrame([row], SCHEMA)
    assert ordered(clicks.windows(df).collect()) == ordered(plain([dict(zip([c.split()[0] for c in SCHEMA.split(", ")], row))]))
    assert clicks.windows(df.limit(0)).collect() == []


def test_query_on_whole_table(spark, sf_dir):
    rows = [r.asDict() for r in common.read(spark, sf_dir, "clicks").collect()]
    assert ordered(clicks.op12_click_windows(spark, sf_dir).collect()) == ordered(plain(rows))


def test_stores_of_a_start_are_closed_when_it_ends(spark):
    """Every start opens stores of its own; were those of earlier ones kept, an executor's memory would grow with starts and partitions."""
    at = datetime.datetime(2024, 1, 1)
    rows = [dict(click_id=i, ts=at, arrived_at=at + datetime.timedelta(hours=5 * i), client_id=i, kind="a", value=1.0, props="") for i in range(40)]
    kept = spark._jvm.org.apache.spark.sql.execution.streaming.state.RocksDBMemoryManager.getNumRocksDBInstances
    before = kept(False)
    assert clicks.windows(spark.createDataFrame(rows, SCHEMA)).count()
    assert kept(False) <= before
