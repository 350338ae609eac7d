"""Stateful behaviours on streams: clock-hour limits, throttled progress, windowed counts."""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_HOUR, _DAY = 3_600_000, 86_400_000  # milliseconds


def hourly_counts(events: DataFrame, *, at: str, key: str, watermark: str = "1 hour", value: str | None = None) -> DataFrame:
    """(hour, key, n[, total]) in tumbling hours; rows later than the watermark are dropped. Works on batches as well."""
    e = events.withWatermark(at, watermark) if events.isStreaming else events
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.sum(value).alias("total")] if value else [])
    return e.groupBy(F.window(at, "1 hour").alias("w"), key).agg(*aggs).select(F.col("w.start").alias("hour"), key, *(["n", "total"] if value else ["n"]))


def limited_calls(calls: DataFrame, *, caller: str, at: str, call_id: str, per_hour: int = 30, buckets: int = 16) -> DataFrame:
    """(caller, call_id, at, accepted) on a stream: a counter per caller and hour; the counters of an hour are dropped
    when the watermark (one hour) has passed it. Calls of one batch are taken in order of time, then id.

    A state costs far more than a call, so one holds the counters of a day's callers of one of ``buckets`` hashes (a
    checkpoint keeps to its number). Calls without a time count as of one hour that never ends."""
    src = calls.select(F.col(caller).cast("string").alias("caller"), F.col(call_id).cast("long").alias("call_id"), F.col(at).cast("timestamp").alias("at"))
    src = src.withColumn("hour", F.unix_millis(F.date_trunc("hour", "at"))).withColumn("day", F.floor(F.col("hour") / _DAY)).withColumn("bucket", F.pmod(F.xxhash64("caller"), F.lit(buckets)))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        passed, timed = state.getCurrentWatermarkMs(), not pd.isna(key[0])
        used = {h: dict(zip(c, n)) for h, c, n in json.loads(state.get[0]) if not timed or h + _HOUR > passed} if state.exists else {}
        pdf = pd.concat(list(batches))
        pdf = pdf.iloc[np.lexsort((pdf["call_id"], pdf["at"]))]
        hours, callers, ok = pdf["hour"].to_numpy(), pdf["caller"].tolist(), []
        cuts = np.flatnonzero(hours[1:] != hours[:-1]) + 1 if timed else []
        for i, j in itertools.pairwise([0, *cuts, len(pdf)]):
            counts = used.setdefault(int(hours[i]) if timed else None, {})
            for c in callers[i:j]:
                n = counts.get(c, 0)
                ok.append(per_hour <= 0 or n < per_hour)
                if ok[-1]:
                    counts[c] = n + 1
        state.update((json.dumps([(h, list(c), list(c.values())) for h, c in used.items()]),))
        if timed:
            # the last hour of a day may end in the next
            state.setTimeoutTimestamp(max((int(key[0]) + 1) * _DAY + _HOUR, passed + 1))
        yield pdf[["caller", "call_id", "at"]].assign(accepted=ok)

    return src.withWatermark("at", "1 hour").groupBy("day", "bucket").applyInPandasWithState(
        step, "caller string, call_id long, at timestamp, accepted boolean", "used string", "append", GroupStateTimeout.EventTimeTimeout
    )


def emitted(rows: list[tuple[float, str]], last: tuple[float, str] | None, gap_ms: int) -> tuple[list[bool], tuple[float, str] | None]:
    """Which of the ordered (milliseconds, stage) are emitted: a new stage, or ``gap_ms`` since the last emitted one."""
    out = []
    for ms, stage in rows:
        hit = last is None or stage != last[1] or ms - last[0] >= gap_ms
        out.append(hit)
        if hit:
            last = (ms, stage)
    return out, last


def throttled_progress(events: DataFrame, *, job: str, at: str, stage: str, event_id: str, gap_ms: int = 500) -> DataFrame:
    """(job, event_id, at, stage) that a throttled listener would write. On a stream the state is the last emitted row of
    each job; in a batch each job is folded once, in chunks as they arrive sorted from the shuffle."""
    src = events.select(F.col(job).cast("string").alias("job"), F.col(event_id).cast("long").alias("event_id"), F.col(at).cast("timestamp").alias("at"), F.col(stage).alias("stage"))

    def fold(pdf: pd.DataFrame, last: tuple[float, str] | None) -> tuple[pd.DataFrame, tuple[float, str] | None]:
        pdf = pdf.sort_values(["at", "event_id"])
        ms = pdf["at"].astype("datetime64[ns]").astype("int64") / 1e6
        keep, last = emitted(list(zip(ms, pdf["stage"])), last, gap_ms)
        return pdf[keep], last

    if not events.isStreaming:
        by_job = src.repartition("job").sortWithinPartitions("job", "at", "event_id")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            # sorted partitions: the fold needs one job's last row, never a whole job
            current, last = None, None
            for pdf in batches:
                outs = [pdf.iloc[:0]]
                for j, part in pdf.groupby("job", sort=False):
                    if j != current:
                        current, last = j, None
                    got, last = fold(part, last)
                    if len(got):
                        outs.append(got)
                yield pd.concat(outs[1:] or outs)

        return by_job.mapInPandas(run, "job string, event_id long, at timestamp, stage string")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, last = fold(pd.concat(list(batches)), tuple(state.get) if state.exists else None)
        if last is not None:
            state.update(last)
        yield out

    return src.groupBy("job").applyInPandasWithState(step, "job string, event_id long, at timestamp, stage string", "ms double, stage string", "append", GroupStateTimeout.NoTimeout)
