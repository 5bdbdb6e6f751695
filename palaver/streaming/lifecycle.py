"""Job lifecycle from an event stream, with state per job.

A state processor (``transformWithStateInPandas``) keeps small states of jobs
(status, times, counters) in shards: the key is a hash of the job id in
``buckets`` classes, so that a call of the processor, which costs a round trip to
the state store, handles all events of a shard's jobs at once. A shard has one
value state and one event-time timer, set to the first time at which passing
time alone changes one of its jobs. Events of a job are applied in ``seq`` order
within a call (Spark gives no order). Time limits, by event time:

* PROCESSING longer than ``timeout_minutes`` becomes FAILED with the
  sweep's message (the service's sweep runs hourly, so it fires 30 to 90
  minutes late; here it fires when the watermark passes the limit);
  the limit is also applied to each event's own time, so a completion that
  comes 45 minutes after the start finds the job timed out whether or not
  both lie in one micro-batch;
* a finished job is dropped ``retention_minutes`` after it finished; a
  tombstone stays for ``tombstone_minutes`` more (one more retention period
  by default) so that late events for it are reported (change = 'late'), not
  applied. Events that come later still find no job and begin a new one; where
  such events exist, a longer time keeps answers free of how batches are cut.

A job that stays PENDING has no limit in the service, so its state is kept.
Events of a job must arrive in ``seq`` order across micro-batches. Shards with
about a hundred live jobs are a good size; the number of ``buckets`` is fixed by
a query's checkpoint.

The output is a change log (one row per state change, numbered per job), appended to any
sink; ``final_states`` reduces it to the latest row per job.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from palaver import schemas as S
from palaver.session import ship_package

FIELDS = ("status", "started_us", "completed_us", "n_events", "n_illegal", "last_seq", "message", "dropped",
          "n_changes", "expires_us")
FRESH = ("PENDING", None, None, 0, 0, None, None, False, 0, None)

CHANGES = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("started_at", T.TimestampNTZType()),
    T.StructField("completed_at", T.TimestampNTZType()),
    T.StructField("n_events", T.LongType()),
    T.StructField("n_illegal", T.LongType()),
    T.StructField("last_seq", T.LongType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("change", T.StringType()),
    T.StructField("change_no", T.LongType()),
    T.StructField("changed_at", T.TimestampNTZType()),
])

ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# A fail event carries no text; a FAILED job needs one.
MSG_EVENT_FAILED = "Job failed"

# Legal moves (state, event kind) -> new state.
MOVES = {("PENDING", "start"): "PROCESSING", ("PENDING", "fail"): "FAILED",
         ("PROCESSING", "complete"): "COMPLETED", ("PROCESSING", "fail"): "FAILED"}


class Limits:
    """What events and passing time do to one job's state (a dict of ``FIELDS``)."""

    def __init__(self, timeout_minutes: int, retention_minutes: int, tombstone_minutes: int):
        self.timeout_us, self.retention_us, self.tombstone_us = (
            m * 60_000_000 for m in (timeout_minutes, retention_minutes, tombstone_minutes))

    def due(self, st: dict) -> tuple[str, int] | None:
        """The next change that passing time alone brings, and when; None if there is none."""
        if st["dropped"]:
            return None
        if st["status"] == "PROCESSING":
            return "timeout", st["started_us"] + self.timeout_us
        if st["status"] in ("COMPLETED", "FAILED"):
            return "dropped", st["completed_us"] + self.retention_us
        return None

    def wakes(self, st: dict) -> int | None:
        """When time next matters to the job, its tombstone's end included."""
        if st["dropped"]:
            return st["expires_us"]
        nxt = self.due(st)
        return nxt[1] if nxt else None

    def pass_time(self, st: dict, change: str, at_us: int) -> tuple[dict, str, int]:
        if change == "timeout":
            st.update(status="FAILED", completed_us=at_us, message=S.MSG_TIMED_OUT)
        else:
            st.update(dropped=True, expires_us=at_us + self.tombstone_us)
        return self._changed(st, change, at_us)

    @staticmethod
    def _changed(st: dict, change: str, at_us: int) -> tuple[dict, str, int]:
        st["n_changes"] += 1
        return dict(st), change, at_us

    def until(self, st: dict, at_us: int) -> Iterator[tuple[dict, str, int]]:
        """Changes up to and at a time."""
        while (nxt := self.due(st)) and nxt[1] <= at_us:
            yield self.pass_time(st, *nxt)

    def events(self, st: dict, events: list[tuple[int, int, str]]) -> Iterator[tuple[dict, str, int]]:
        """Changes by (seq, time, kind) in order; consecutive events make one update."""
        late, applied, last_us = [], False, 0
        for seq, us, kind in events:
            # what time alone changed before this event comes first, wherever the batches were cut
            while (nxt := self.due(st)) and us > nxt[1]:
                if applied:
                    yield self._changed(st, "update", last_us)
                    applied = False
                yield self.pass_time(st, *nxt)
            if st["dropped"]:
                late.append((seq, us))
                continue
            applied, last_us = True, us
            st["n_events"] += 1
            st["last_seq"] = seq if st["last_seq"] is None else max(seq, st["last_seq"])
            new = MOVES.get((st["status"], kind))
            if new is None:
                st["n_illegal"] += 1
                continue
            if new == "PROCESSING":
                st["started_us"] = us
            else:
                st["completed_us"] = us
                st["message"] = MSG_EVENT_FAILED if new == "FAILED" else None
            st["status"] = new
        if applied:
            yield self._changed(st, "update", last_us)
        if late:
            yield dict(st, n_events=len(late), last_seq=late[-1][0]), "late", late[-1][1]


def _rows(found: list[tuple[str, dict, str, int]]) -> pd.DataFrame:
    """Change rows of (job id, state, change, time)."""
    def stamps(values):
        return np.array(["NaT" if v is None else v for v in values], dtype="datetime64[us]")

    def longs(name):
        return np.array([st[name] for _, st, _, _ in found], dtype=np.int64)

    return pd.DataFrame({
        "job_id": [j for j, *_ in found], "status": [st["status"] for _, st, _, _ in found],
        "started_at": stamps([st["started_us"] for _, st, _, _ in found]),
        "completed_at": stamps([st["completed_us"] for _, st, _, _ in found]),
        "n_events": longs("n_events"), "n_illegal": longs("n_illegal"), "last_seq": longs("last_seq"),
        "error_message": pd.Series([st["message"] for _, st, _, _ in found], dtype=object),
        "change": [c for _, _, c, _ in found], "change_no": longs("n_changes"),
        "changed_at": stamps([us for *_, us in found])}, columns=CHANGES.fieldNames())


class LifecycleProcessor(StatefulProcessor):
    """States of a shard's jobs in one value, with one timer for the first that time changes."""

    def __init__(self, limits: Limits):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.shard = handle.getValueState("jobs", "jobs string, timer long")

    def _load(self) -> tuple[dict[str, dict], int | None]:
        row = self.shard.get() if self.shard.exists() else None
        if row is None:
            return {}, None
        return {j: dict(zip(FIELDS, st)) for j, st in json.loads(row[0]).items()}, row[1]

    def _save(self, jobs: dict[str, dict], timer: int | None, watermark_ms: int) -> None:
        wakes = [w for st in jobs.values() if (w := self.limits.wakes(st)) is not None]
        nxt = max(-(-min(wakes) // 1000), watermark_ms + 1) if wakes else None
        if timer is not None and timer != nxt and timer > watermark_ms:
            self.handle.deleteTimer(timer)
        if nxt is not None and nxt != timer:
            self.handle.registerTimer(nxt)
        if jobs:
            self.shard.update((json.dumps({j: [st[f] for f in FIELDS] for j, st in jobs.items()}), nxt))
        else:
            self.shard.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        jobs, timer = self._load()
        events: dict[str, list[tuple[int, int, str]]] = {}
        for pdf in rows:
            stamps = pdf["ts"].to_numpy().astype("datetime64[us]").astype(np.int64).tolist()
            for j, seq, us, kind in zip(pdf["job_id"].tolist(), pdf["seq"].tolist(), stamps, pdf["kind"].tolist()):
                events.setdefault(j, []).append((seq, us, kind))
        found = []
        for j, own in events.items():
            st = jobs.setdefault(j, dict(zip(FIELDS, FRESH)))
            found += [(j, *c) for c in self.limits.events(st, sorted(own, key=lambda e: e[0]))]
        self._save(jobs, timer, timerValues.getCurrentWatermarkInMs())
        if found:
            yield _rows(found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        jobs, timer = self._load()
        at_us = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000
        found = []
        for j, st in list(jobs.items()):
            found += [(j, *c) for c in self.limits.until(st, at_us)]
            if st["dropped"] and st["expires_us"] <= at_us:
                del jobs[j]  # the tombstone has had its time
        self._save(jobs, timer, at_us // 1000)
        if found:
            yield _rows(found)

    def close(self) -> None:
        pass


def lifecycle_changes(events: DataFrame, timeout_minutes: int = S.JOB_TIMEOUT_MINUTES,
                      retention_minutes: int = S.RETENTION_HOURS * 60, watermark_delay: str = "10 minutes",
                      tombstone_minutes: int | None = None, buckets: int = 1024) -> DataFrame:
    """Change log of job states from a streaming frame ``job_id, seq, ts, kind``."""
    ship_package(events.sparkSession)
    src = (events.select("job_id", "seq", "ts", "kind", F.col("ts").cast("timestamp").alias("event_time"),
                         F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int").alias("bucket"))
           .withWatermark("event_time", watermark_delay))
    limits = Limits(timeout_minutes, retention_minutes,
                    retention_minutes if tombstone_minutes is None else tombstone_minutes)
    return src.groupBy("bucket").transformWithStateInPandas(LifecycleProcessor(limits), CHANGES, "Append", "EventTime")


def final_states(changes: DataFrame) -> DataFrame:
    """Latest state per job from the change log.

    A job has at most a few change rows per micro-batch, so a per-job
    ``row_number`` (planned as a group limit) stays small for every key.
    """
    w = Window.partitionBy("job_id").orderBy(F.col("changed_at").desc(), F.col("change_no").desc())
    return (changes.where(F.col("change") != "late")
            .withColumn("_r", F.row_number().over(w)).where("_r = 1")
            .select(*CHANGES.fieldNames()))


def lifecycle_stream(spark, events_dir: str, out_dir: str, checkpoint_dir: str,
                     timeout_minutes: int = S.JOB_TIMEOUT_MINUTES,
                     retention_minutes: int = S.RETENTION_HOURS * 60,
                     available_now: bool = True, state_partitions: int | None = None,
                     tombstone_minutes: int | None = None, buckets: int = 1024, files_per_batch: int | None = None):
    """Start W2 over parquet event files; the change log is appended to ``out_dir``.

    Per-job state goes to the RocksDB state store (off-heap, sized for
    millions of keys) unless the session already names a provider; a query
    restarted from its checkpoint keeps the provider it started with.
    ``state_partitions`` sets the number of state partitions of a new query
    (fixed in its checkpoint from then on); by default the session's
    ``spark.sql.shuffle.partitions``.
    """
    key = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(key, "").endswith("HDFSBackedStateStoreProvider") or not spark.conf.get(key, ""):
        spark.conf.set(key, ROCKSDB_PROVIDER)
    schema = T.StructType([T.StructField("job_id", T.StringType()), T.StructField("seq", T.LongType()),
                           T.StructField("ts", T.TimestampNTZType()), T.StructField("kind", T.StringType())])
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    changes = lifecycle_changes(reader.parquet(events_dir), timeout_minutes, retention_minutes,
                                tombstone_minutes=tombstone_minutes, buckets=buckets)
    w = (changes.writeStream.format("parquet")
         .option("path", out_dir).option("checkpointLocation", checkpoint_dir).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    if state_partitions is None:
        return w.start()
    # the query clones the session conf when it starts; restore it right after
    prev = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(state_partitions))
    try:
        return w.start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", prev)
