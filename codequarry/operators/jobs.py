"""Job status as an append-only log, retention, rate limits, retries."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.operators.prefix import running_total, value_buckets

T = TypeVar("T")
#: States of a job, and the moves allowed between them.
MOVES = {"QUEUED": ["RUNNING", "FAILED"], "RUNNING": ["RUNNING", "DONE", "FAILED"], "DONE": ["FAILED"], "FAILED": []}


def latest(log: DataFrame, *, key: str, at: str) -> DataFrame:
    """The current row of each key: the newest, ties settled by the rest of the row."""
    rest = [c for c in log.columns if c not in (key, at)]
    return log.groupBy(key).agg(F.max(F.struct(at, *rest)).alias("r")).select(key, "r.*")


def valid_moves(log: DataFrame, *, key: str, at: str, status: str) -> DataFrame:
    """Every row of the log with the status before it and whether the move is allowed; the first must be QUEUED."""
    w = Window.partitionBy(key).orderBy(at, status)
    prev = F.lag(status).over(w)
    allowed = F.create_map(*(x for k, v in MOVES.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if v else F.array().cast("array<string>"))))
    return log.withColumn("previous", prev).withColumn("allowed", F.when(F.col("previous").isNull(), F.col(status) == "QUEUED").otherwise(F.coalesce(F.array_contains(allowed[F.col("previous")], F.col(status)), F.lit(False))))


def active(jobs: DataFrame, *, source: str, status: str = "status") -> DataFrame:
    """Jobs still queued or running, by source."""
    return jobs.filter(F.col(status).isin("QUEUED", "RUNNING")).select(source, *[c for c in jobs.columns if c != source])


def admit(requests: DataFrame, jobs: DataFrame, *, source: str) -> DataFrame:
    """Requests whose source has no active job; others get that job instead."""
    return requests.join(active(jobs, source=source).select(source), source, "left_anti")


def abandon(jobs: DataFrame, *, status: str = "status") -> DataFrame:
    """On start: whatever was unfinished has failed."""
    return jobs.withColumn(status, F.when(F.col(status).isin("QUEUED", "RUNNING"), "FAILED").otherwise(F.col(status)))


def recent_done(jobs: DataFrame, *, at: str, status: str = "status", most: int = 20) -> DataFrame:
    """Newest finished jobs; ``most`` is kept within 1 and 100."""
    return jobs.filter(F.col(status) == "DONE").orderBy(F.desc(at)).limit(max(1, min(100, most)))


def kept_jobs(jobs: DataFrame, *, key: str, at: str, status: str = "status", keep: int = 20) -> DataFrame:
    """Keys of the newest ``keep`` finished jobs; the partitions of all others may be dropped."""
    return jobs.filter(F.col(status) == "DONE").orderBy(F.desc(at), key).limit(keep).select(key)


def rate_limit(calls: DataFrame, *, caller: str, at: str, order: str, per_hour: int = 30) -> DataFrame:
    """Calls with ``accepted``: the first ``per_hour`` of each caller and clock hour; 0 switches the limit off.

    The window runs within (caller, hour), which even a busy caller cannot make unbounded."""
    if per_hour <= 0:
        return calls.withColumn("accepted", F.lit(True))
    w = Window.partitionBy(caller, F.date_trunc("hour", at)).orderBy(at, order)
    return calls.withColumn("accepted", F.row_number().over(w) <= per_hour)


def queue_depth(log: DataFrame, *, worker: str, key: str, submitted: str, started: str, capacity: int = 20, parts: int = 64) -> DataFrame:
    """(worker, key, waiting, rejected): how many earlier jobs of the worker still waited when a job was submitted.

    Submissions count +1 and starts -1 on one line of time; a start at the very moment of a submission comes first, equal
    submissions are ordered by key. A job is rejected when ``capacity`` wait. Jobs without a start wait for ever. The
    running total is cut into buckets of time, so one worker's line is not one task's."""
    a, b = (F.unix_micros(F.col(c).cast("timestamp")) for c in (submitted, started))
    waits = F.when(b.isNull() | (b > a), 1).otherwise(0)  # a job that starts at once never waits
    s = log.select(F.col(worker).alias("w"), F.col(key).alias("k"), a.alias("t"), F.lit(1).alias("ask"), waits.alias("d"))
    e = log.filter(b > a).select(F.col(worker).alias("w"), F.col(key).alias("k"), b.alias("t"), F.lit(0).alias("ask"), F.lit(-1).alias("d"))
    line = value_buckets(s.unionByName(e), ["w"], "t", "b", parts)
    r = running_total(line, ["w"], "b", ["t", "ask", "k"], F.col("d"), "waiting").filter("ask = 1")
    return r.select(F.col("w").alias(worker), F.col("k").alias(key), "waiting", (F.col("waiting") >= capacity).alias("rejected"))


def as_of(questions: DataFrame, log: DataFrame, *, key: str, at: str, value: str, order: str) -> DataFrame:
    """The questions (key, at) with the last ``value`` of the log at or before them; null before the first.

    As-of join by one sort: log rows and questions of a key on one line, the last seen value carried forward; of equal
    times the log row with the greatest ``order`` counts."""
    q = questions.select(F.col(key).alias("k"), F.col(at).alias("t"), F.lit(None).cast(log.schema[value].dataType).alias("v"), F.lit(1).alias("ask"), F.lit(None).cast(log.schema[order].dataType).alias("o"))
    x = log.select(F.col(key).alias("k"), F.col(at).alias("t"), F.col(value).alias("v"), F.lit(0).alias("ask"), F.col(order).alias("o"))
    w = Window.partitionBy("k").orderBy("t", "ask", "o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return q.unionByName(x).withColumn("v", F.last("v", ignorenulls=True).over(w)).filter("ask = 1").select(F.col("k").alias(key), F.col("t").alias(at), F.col("v").alias(value))


def stage_changes(events: DataFrame, *, key: str, at: str, order: str, stage: str) -> DataFrame:
    """Events that open a new stage of their key."""
    w = Window.partitionBy(key).orderBy(at, order)
    return events.withColumn("__p", F.lag(stage).over(w)).filter(F.col("__p").isNull() | (F.col("__p") != F.col(stage))).drop("__p")


def with_retries(call: Callable[[], T], attempts: int = 3, pause: float = 2.0, transient: tuple[type[BaseException], ...] = (OSError, TimeoutError)) -> T:
    """Calls until it succeeds; waits pause x attempt after a transient failure, empty results count as such."""
    for i in range(1, attempts + 1):
        try:
            out = call()
            if out not in (None, "", b""):
                return out
            problem: BaseException = ValueError("empty result")
        except transient as e:
            problem = e
        if i < attempts:
            time.sleep(pause * i)
    raise problem
