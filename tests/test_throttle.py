"""Limited calls on streams of several batches."""

import datetime as dt
import random
from collections import Counter

import pytest

from codequarry.streaming import throttle


def run(spark, folder, per_hour):
    """Rows and the number of states of a stream that takes one file a batch."""
    s = spark.readStream.schema("who string, id long, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    q = throttle.limited_calls(s, caller="who", at="at", call_id="id", per_hour=per_hour).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    return {r.call_id: r.accepted for r in spark.read.parquet(f"{folder}/out").collect()}, states


def expected(batches, per_hour):
    used, out = Counter(), {}
    for rows in batches:
        for who, i, at in sorted(rows, key=lambda r: (r[2] is None, r[2] or r[1], r[1])):
            k = (who, at and at.replace(minute=0, second=0))
            out[i] = used[k] < per_hour or per_hour <= 0
            used[k] += out[i]
    return out


@pytest.mark.parametrize("per_hour", [2, 0])
def test_limited_calls_over_batches(spark, tmp_path, per_hour):
    rnd, start = random.Random(3), dt.datetime(2024, 1, 1, 22)
    batches = []
    for k in range(2):
        # both batches have calls from 23:10 to 23:50; the second goes on into the next day
        at = lambda: start + dt.timedelta(minutes=rnd.randrange(110) + 70 * k, seconds=rnd.randrange(60))
        rows = [(rnd.choice([*"abcdefgh", None, "null"]), 1000 * k + i, at()) for i in range(150)]
        batches.append(rows + [(rnd.choice(["a", None]), 1000 * k + 900 + i, None) for i in range(4)])
        spark.createDataFrame(batches[-1], "who string, id long, at timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got, states = run(spark, tmp_path, per_hour)
    assert got == expected(batches, per_hour)
    # a state per day and bucket, not one per caller and hour; one day is without a time
    assert 0 < max(states) <= 3 * 16
