"""Job leases as a fold of an event log, in batch and as a stream, and the rule for late results.

Events: job_id, event (claim, renew, finish, fail), token, lease_seconds, ts. A claim of a job that isn't held starts an attempt; a renewal by the holder
moves the end; an end that passes makes the attempt abandoned and the job queued again. A finish counts only from the holder, in time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATE = "status string, attempts int, token string, expires double, abandoned int"
OUT = f"job_id bigint, {STATE}"


def lease_state(events: DataFrame, now: float) -> DataFrame:
    """Every job's state at `now` (epoch seconds): one fold over its events in order. A job's log is short; jobs are many."""
    log = F.array_sort(F.collect_list(F.struct(F.col("ts").cast("double").alias("ts"), "seq", "event", "token", F.col("lease_seconds").cast("double").alias("lease"))))
    held = "(s.token is not null and s.token = e.token and s.expires > e.ts)"
    folded = F.expr(f"""
        aggregate(array_append(log, named_struct('ts', {now}D, 'seq', cast(null as bigint), 'event', 'look', 'token', cast(null as string), 'lease', 0D)),
          named_struct('status', 'queued', 'attempts', 0, 'token', cast(null as string), 'expires', cast(null as double), 'abandoned', 0),
          (t, e) -> transform(array(if(t.status = 'running' and t.expires <= e.ts,
              named_struct('status', 'queued', 'attempts', t.attempts, 'token', cast(null as string), 'expires', cast(null as double), 'abandoned', t.abandoned + 1), t)), s ->
            case when e.event = 'claim' and s.status = 'queued' then named_struct('status', 'running', 'attempts', s.attempts + 1, 'token', e.token, 'expires', e.ts + e.lease, 'abandoned', s.abandoned)
                 when e.event = 'renew' and {held} then named_struct('status', s.status, 'attempts', s.attempts, 'token', s.token, 'expires', e.ts + e.lease, 'abandoned', s.abandoned)
                 when e.event in ('finish', 'fail') and {held} then named_struct('status', if(e.event = 'finish', 'done', 'failed'), 'attempts', s.attempts, 'token', cast(null as string), 'expires', cast(null as double), 'abandoned', s.abandoned)
                 else s end)[0])
    """)
    return events.groupBy("job_id").agg(log.alias("log")).select("job_id", F.explode(F.array(folded)).alias("s")).select("job_id", "s.*")


def step(state: tuple, at: float, event: str, token: str | None, lease: float | None) -> tuple:
    """status, attempts, token, expires, abandoned after an event, as lease_state() folds it."""
    status, attempts, holder, expires, abandoned = state
    if status == "running" and expires <= at:
        status, holder, expires, abandoned = "queued", None, None, abandoned + 1
    held = holder is not None and holder == token and expires > at
    if event == "claim" and status == "queued":
        return "running", attempts + 1, token, at + lease, abandoned
    if event == "renew" and held:
        return status, attempts, holder, at + lease, abandoned
    if event in ("finish", "fail") and held:
        return "done" if event == "finish" else "failed", attempts, None, None, abandoned
    return status, attempts, holder, expires, abandoned


WAITING = "at bigint, seq bigint, event string, token string, lease double"


class LeaseProcessor(StatefulProcessor):
    """The same fold in the order of event time, whatever order events arrive in.

    An event waits in a list until the watermark reaches it: no earlier one can come any more. Timers stand at the times of waiting events and at the lease's end, in milliseconds.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("lease", STATE)
        self.waiting = handle.getListState("waiting", WAITING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        plain = lambda x: None if pd.isna(x) else x
        new = [(int(e.ts.value // 1000), int(e.seq), e.event, plain(e.token), plain(e.lease_seconds)) for some in rows for e in some.itertuples()]
        self.waiting.appendList(new)
        for at in {-(-t // 1000) for t, *_ in new}:
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        due = sorted((tuple(e) for e in waiting if e[0] <= mark), key=lambda e: (e[0], e[1], e[2] or "", e[3] or "", e[4] or 0.0))
        before = tuple(self.state.get()) if self.state.exists() else None
        state = before or ("queued", 0, None, None, 0)
        for at, _, event, token, lease in due:
            state = step(state, at / 1e6, event, token, lease)
        state = step(state, mark / 1e6, "look", None, None)
        if due:
            later = [tuple(e) for e in waiting if e[0] > mark]
            self.waiting.put(later) if later else self.waiting.clear()
        if state == before:
            return
        self.state.update(state)
        if state[3] is not None:
            self.handle.registerTimer(math.ceil(state[3] * 1000))
        yield pd.DataFrame([(key[0], *state)], columns=["job_id", "status", "attempts", "token", "expires", "abandoned"])

    def close(self) -> None:
        pass


def lease_stream(events: DataFrame, watermark: str = "1 minute") -> DataFrame:
    """Each state that a job comes to, up to the watermark: what lease_state() says of the events up to there. Events later than the watermark allows are dropped. Needs the RocksDB state store."""
    timed = events.withWatermark("ts", watermark)
    return timed.groupBy("job_id").transformWithStateInPandas(LeaseProcessor(), outputStructType=OUT, outputMode="update", timeMode="EventTime")


def fence_results(results: DataFrame, leases: DataFrame) -> DataFrame:
    """results (job_id, token, published) against leases (job_id, token, expires): accepted only with the current token and before its end."""
    current = leases.select("job_id", F.col("token").alias("_token"), F.col("expires").alias("_expires"))
    found = results.join(current, "job_id", "left")
    why = F.when(F.col("_token").isNull(), "no_lease").when(F.col("token") != F.col("_token"), "stale_token").when(F.col("published").cast("double") >= F.col("_expires"), "expired")
    return found.withColumn("rejected", why).withColumn("accepted", F.col("rejected").isNull()).drop("_token", "_expires")


def fence_stream(results: DataFrame, leases: DataFrame, *, delay: str = "1 minute", horizon: str = "1 hour") -> DataFrame:
    """results (id, job_id, token, published) with rejected and accepted, judged by the leases (job_id, token, since, expires: a row a claim or renewal) that were in force when they were published.

    Both are streams that may be late by `delay`. A result waits until no lease for its time can come any more, so one that comes before its lease is judged by it all the same; leases that began more than `horizon`
    before are forgotten, and a verdict comes once the watermark is that far past its result. Ids tell results apart: one that comes twice is judged once.
    """
    held = leases.withWatermark("since", delay).select(F.col("job_id").alias("_job"), F.col("token").alias("_token"), "since", "expires")
    told = results.withWatermark("published", delay)
    within = (F.col("job_id") == F.col("_job")) & (F.col("published") >= F.col("since")) & (F.col("published") < F.col("since") + F.expr(f"interval {horizon}"))
    met = told.join(held, within, "left")
    own, on = F.col("token") == F.col("_token"), F.col("published") < F.col("expires")
    any_of = lambda c: F.coalesce(F.max(F.coalesce(c, F.lit(False)).cast("int")), F.lit(0)) == 1
    judged = met.groupBy("id", "job_id", "token", "published").agg(any_of(own & on).alias("accepted"), any_of(~own & on).alias("_other"), any_of(F.col("_job").isNotNull()).alias("_some"))
    why = F.when(F.col("accepted"), None).when(F.col("_other"), "stale_token").when(F.col("_some"), "expired").otherwise("no_lease")
    return judged.withColumn("rejected", why).drop("_other", "_some")


def write_fenced(judged: DataFrame, accepted_path: str, rejected_path: str, checkpoint: str) -> StreamingQuery:
    """Accepted results go to one table, rejected ones to another. A batch is a folder of each, written over when the batch runs again, so nothing is there twice."""

    def each(batch: DataFrame, number: int) -> None:
        for path, rows in ((accepted_path, batch.filter("accepted")), (rejected_path, batch.filter("not accepted"))):
            rows.drop("accepted").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return judged.writeStream.foreachBatch(each).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_history(events: DataFrame) -> DataFrame:
    """Each claim is a run of its own; each success a new version."""
    along = Window.partitionBy("job_id").orderBy("ts", "seq")
    numbered = events.filter(F.col("event").isin("claim", "finish")).withColumn("run_no", F.sum(F.when(F.col("event") == "claim", 1).otherwise(0)).over(along)).withColumn("version_no", F.sum(F.when(F.col("event") == "finish", 1).otherwise(0)).over(along))
    return numbered.select("job_id", "event", "ts", "run_no", "version_no")
