"""Expiring deduplication of clicks: a Structured Streaming query whose state is dealt to hashed buckets.

A bucket's state is two maps: click_id to its open window, and deadline hour to the ids of windows that end then (a
timing wheel). One event-time timer a bucket stands at the wheel's first slot; when the watermark passes it, all slots
behind the watermark are drained and the timer moves on. The watermark trails the largest hour by the lateness, so that
Spark drops late rows and fires timers by itself.

Within a batch a bucket's rows are counted by (click_id, hour, hash) and folded in that order. At its end the wheel is
drained as far as the bucket's own rows prove the next watermark to be, so that only what outlives the batch is put into
the state; what the watermark alone tells is drained in the next batch, by the timer where the bucket has no rows, and
counts for the batch before. The number of buckets grows with the input, so that a
bucket's share of a batch stays small. Copies come as rows; a stateless pass packs those of a bucket that lie in one Arrow
batch.

Defined results: a null click_id is an id like any other (its copies are j = 0 alone, as are those of negative ids); rows
without arrived_at have no hour and take no part; nulls in other columns are empty in the hash; repeated rows are
repeats; NaN counts as 0 and infinite values as the largest long in the hash; an empty table gives no rows. Extra columns
are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from . import common

HOUR_MS = 3_600_000
FED = "bucket long, click_id long, hour long, hash binary"
#: Copies of one bucket in an Arrow batch come in one row, windows that close together go out in one: rows of arrays pass
#: the Row-based interface faster. A row's event time is that of its largest hour; the processor drops late copies itself.
PACKED = "bucket long, click_ids array<long>, hours array<long>, hashes array<binary>, event_time timestamp"
CLOSED = "click_id array<long>, start_hour array<long>, n_repeats array<long>, n_conflicts array<long>, conflict_crc array<long>, hash array<binary>, before array<boolean>"
TOLD = 2000
RESULT = "click_id long, start_hour long, closed_batch long, n_repeats long, n_conflicts long, conflict_crc long, hash string"
RESULT_COLUMNS = [c.split()[0] for c in RESULT.split(", ")]
WINDOW = "start_hour long, n_repeats long, n_conflicts long, conflict_crc long, hash binary"
_closed_row = Row(*(c.split()[0] for c in CLOSED.split(", ")))
#: Maps and timers need the RocksDB store, which hands changes to the checkpoint. A start is one batch: its timers tell
#: what the batch before left behind.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: nothing is reserved ahead
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # each start opens stores of its own; those of earlier ones would stay open
    "spark.sql.execution.arrow.maxRecordsPerBatch": "50000",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
#: The bucket of the marker that ends a stream.
MARKER = -1


class Windows(StatefulProcessor):
    """Opens, extends and closes windows of click ids; emits them as they close.

    span: a window takes what comes up to so many hours after its start. lateness: the watermark's distance in hours.
    base: the hour that event times count from; last: the largest hour of all.

    What the watermark leaves behind is over since the batch before, which told it; it is drained before a batch's rows are
    looked at, or by the timer of a bucket without rows. Such windows go out marked. Behind the marker's watermark, which
    is beyond the last hour, all are over with the last batch itself.
    """

    def __init__(self, span: int, lateness: int, base: int, last: int):
        self.span, self.lateness, self.base, self.last = span, lateness, base, last

    def init(self, handle) -> None:
        self.handle = handle
        self.windows = handle.getMapState("windows", "click_id long", WINDOW)
        self.wheel = handle.getMapState("wheel", "hour long", "ids array<long>")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        seen: Counter = Counter()
        bound = self._bound(timerValues)
        for row in rows:
            seen.update((i is not None, i or 0, hour, digest) for i, hour, digest in zip(row["click_ids"], row["hours"], row["hashes"]) if hour >= bound)
        if key[0] != MARKER:
            yield from _told(self._folded(seen, bound))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        bound, held, slots = self._bound(timerValues), self._held(), self._slots()
        windows, wheel = dict(held), dict(slots)
        over = self._drained(bound, windows, wheel)
        yield from _told((*w, bound <= self.last) for w in over)
        self._kept(held, windows, slots, wheel, expiredTimerInfo.getExpiryTimeInMs())

    def _folded(self, seen: Counter, bound: int) -> Iterator[tuple]:
        held, slots = self._held(), self._slots()
        windows, wheel = dict(held), dict(slots)
        for window in self._drained(bound, windows, wheel):
            yield *window, True
        touched: dict = {}
        newest = self.base
        for known, click_id, hour, digest in sorted(seen):
            n = seen[known, click_id, hour, digest]
            click_id = click_id if known else None
            newest = max(newest, hour)
            window = windows.get(click_id)
            if window is None or hour > window[0] + self.span:
                if window is not None:
                    yield click_id, *window, False
                window = (hour, 0, 0, 0, digest)
                n -= 1
                touched[click_id] = hour
            start, repeats, conflicts, crc, first = window
            if digest != first:
                conflicts, crc = conflicts + n, crc + n * zlib.crc32(digest.hex().encode())
            windows[click_id] = (start, repeats + n, conflicts, crc, first)
        for click_id, start in touched.items():
            wheel[start + self.span] = [*wheel.get(start + self.span, ()), click_id]
        # The next watermark is at least as far as the bucket's own rows ask: what lies behind that is over with this batch.
        for window in self._drained(newest - self.lateness, windows, wheel):
            yield *window, False
        self._kept(held, windows, slots, wheel)

    def _bound(self, timerValues) -> int:
        """The first hour that is not behind the watermark."""
        return (timerValues.getCurrentWatermarkInMs() + 1) // HOUR_MS + self.base

    def _drained(self, bound: int, windows: dict, wheel: dict) -> Iterator[tuple]:
        """Takes the slots before the bound off the wheel, and gives their windows; an id that has moved on since stays."""
        for hour in [h for h in wheel if h < bound]:
            for click_id in wheel.pop(hour):
                if click_id in windows and windows[click_id][0] + self.span == hour:
                    yield click_id, *windows.pop(click_id)

    def _kept(self, held: dict, windows: dict, slots: dict, wheel: dict, fired: int | None = None) -> None:
        _replace(self.windows, held, windows)
        _replace(self.wheel, {h: (ids,) for h, ids in slots.items()}, {h: (ids,) for h, ids in wheel.items()})
        self._set_timer(wheel, fired)

    def _held(self) -> dict:
        return {click_id: window for (click_id,), window in self.windows.iterator()} if self.windows.exists() else {}

    def _slots(self) -> dict:
        return {hour: ids for (hour,), (ids,) in self.wheel.iterator()} if self.wheel.exists() else {}

    def _set_timer(self, wheel: dict, fired: int | None = None) -> None:
        """The bucket's one timer goes to the first slot, just before the least watermark that leaves the slot's hour behind."""
        at = (min(wheel) + 1 - self.base) * HOUR_MS - 2 if wheel else None
        set_now = [t for t in self.handle.listTimers() if t != fired]
        if at not in set_now:
            if at is not None:
                self.handle.registerTimer(at)
        for t in set_now:
            if t != at:
                self.handle.deleteTimer(t)


def _told(closed: Iterator[tuple]) -> Iterator[Row]:
    """Windows as rows of arrays, so many to a row."""
    while some := list(islice(closed, TOLD)):
        yield _closed_row(*map(list, zip(*some)))


def _packed(base: int):
    """The batch function that packs copies by bucket."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        buckets, hours = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "hour"))
        order = np.argsort(buckets, kind="stable")
        starts = np.flatnonzero(np.diff(buckets[order], prepend=buckets[order][:1] - 1)) if len(order) else order
        offsets = pa.array(np.append(starts, len(order)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, batch.column(c).take(pa.array(order))) for c in ("click_id", "hour", "hash")]
        latest = np.maximum.reduceat(hours[order], starts) if len(order) else hours
        times = pa.array((latest - base) * (HOUR_MS * 1000), pa.int64()).cast(pa.timestamp("us", tz="UTC"))
        return pa.RecordBatch.from_arrays([pa.array(buckets[order][starts], pa.int64()), *lists, times], [c.split()[0] for c in PACKED.split(", ")])

    return f


def _replace(state, old: dict, new: dict) -> None:
    """Makes a map of old entries one of new ones, by as few calls as it takes: each goes through a socket."""
    gone = [k for k in old if k not in new]
    changed = [k for k, v in new.items() if old.get(k) != v]
    if len(gone) > len(new) - len(changed):
        state.clear()
        changed, gone = list(new), []
    for k in gone:
        state.removeKey((k,))
    for k in changed:
        state.updateValue((k,), new[k])


def copies(clicks: DataFrame, hours: int = 6, turns: int = 10, delays: int = 200) -> DataFrame:
    """click_id, hour, late (the hour by which a copy is fed) and hash of every copy of every click. The session's zone has to be UTC."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    j = F.explode(F.sequence(F.lit(0), F.greatest(F.coalesce(F.col("click_id") % 3, F.lit(0)), F.lit(0)).cast("int")))
    every = clicks.where("arrived_at IS NOT NULL").select(
        F.col("click_id").cast("long").alias("click_id"),
        F.floor(micros("arrived_at") / F.lit(3.6e9)).alias("arrived"),
        _texts("client_id", "kind", F.floor(F.lit(100.0) * F.col("value") + F.lit(0.5)), micros("ts"), "props").alias("content"),
        j.alias("j"),
    )
    crc = F.crc32(F.concat(F.coalesce(F.col("click_id").cast("string"), F.lit("")), F.lit(":"), F.col("j").cast("string")))
    placed = every.withColumn("c", crc).withColumn("hour", F.col("arrived") + F.col("j") * hours * (F.col("c") % turns))
    late = F.col("hour") + F.floor(F.col("c") / F.lit(float(turns))) % delays
    digest = F.unhex(F.sha2(F.concat(F.col("content"), F.lit("|"), (F.col("c") % 3).cast("string")), 256))
    return placed.select("click_id", "hour", late.alias("late"), digest.alias("hash"))


def _texts(*columns) -> Column:
    texts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns]
    return F.concat_ws("|", *texts)


def _moved(spark: SparkSession, source: str, target: str) -> bool:
    """Renames a folder of the shared store; one that isn't there is an empty batch."""
    source, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (source, target))
    files = source.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(source) and not files.rename(source, target):
        raise OSError(f"{source} could not be moved to {target}")
    return files.exists(target)


def _started(spark: SparkSession, root: str, batch: int, before: int, processor: Windows) -> None:
    """One start of the query: takes what is new in the folder, and ends. before: the batch that was fed before this one."""
    delay = processor.lateness * HOUR_MS + 1  # the watermark is just before the first hour that isn't late
    copies = spark.readStream.schema(FED).option("recursiveFileLookup", "true").parquet(f"{root}/fed")
    packed = common.map_batches(copies, lambda: _packed(processor.base), PACKED, rows=50_000)
    stream = packed.withWatermark("event_time", f"{delay} milliseconds")
    closed = stream.groupBy("bucket").transformWithState(processor, CLOSED, "append", "eventTime")

    def store(rows: DataFrame, epoch: int) -> None:
        each = rows.select(F.inline(F.arrays_zip(*rows.columns)))
        of = F.when(F.col("before"), F.lit(before)).otherwise(F.lit(batch)).cast("long")
        each.withColumn("closed_batch", of).drop("before").write.mode("overwrite").parquet(f"{root}/closed/{batch}-{epoch}")

    query = closed.writeStream.foreachBatch(store).outputMode("append").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def windows(clicks: DataFrame, batches: int = 8, span: int = 24, lateness: int = 96, rows_per_bucket: int = 160_000) -> DataFrame:
    """click_id, start_hour, closed_batch, n_repeats, n_conflicts, conflict_crc, hash of every window of the clicks' copies.

    The copies are written once, by batch, in the shared folder; each batch is moved into the folder that the stream
    reads, and the query is started for it on one checkpoint and ends when it has taken all there is. A marker far ahead
    comes with the last batch: a batch without data follows then, in which the watermark passes every deadline.
    """
    spark = clicks.sparkSession
    root = f"{common.shared_dir(spark)}/click-windows-{uuid.uuid4().hex}"
    with common.settings(spark, **SETTINGS):
        every = copies(clicks)
        low, high, n, first, last = every.agg(F.min("late"), F.max("late"), F.count("*"), F.min("hour"), F.max("hour")).first()
        if not n:
            return spark.createDataFrame([], RESULT)
        base = first - lateness - 1  # event times count from here, so that none is before a watermark's beginning
        place = F.floor((F.col("late") - low) * batches / F.lit(float(high - low + 1)))
        bucket = F.pmod(F.xxhash64("click_id"), F.lit(max(8, n // rows_per_bucket)))
        every.select(place.alias("batch"), bucket.alias("bucket"), "click_id", "hour", "hash").write.partitionBy("batch").parquet(f"{root}/dealt")
        spark.createDataFrame([], FED).write.parquet(f"{root}/fed/none")  # the folder is there, whichever batches are empty
        end = spark.createDataFrame([(MARKER, None, last + span + lateness + 2, None)], FED)
        end.write.parquet(f"{root}/dealt/batch={batches}")
        processor, before = Windows(span, lateness, base, last), 0
        for k in range(batches):
            filled = _moved(spark, f"{root}/dealt/batch={k}", f"{root}/fed/{k}")
            if k == batches - 1:
                _moved(spark, f"{root}/dealt/batch={batches}", f"{root}/fed/end")
                with common.settings(spark, **{"spark.sql.streaming.noDataMicroBatches.enabled": "true"}):
                    _started(spark, root, k, before, processor)
            elif filled:
                _started(spark, root, k, before, processor)
                before = k
    kinds = RESULT.replace("hash string", "hash binary")
    closed = spark.read.schema(kinds).option("recursiveFileLookup", "true").parquet(f"{root}/closed")
    return closed.select(*RESULT_COLUMNS[:-1], F.lower(F.hex("hash")).alias("hash"))


def op12_click_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows(common.read(spark, sf_dir, "clicks"))
