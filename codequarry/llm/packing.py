"""Filling fixed-capacity containers: shortest-pack-first over the histogram of lengths.

Only the histogram, at most ``capacity`` counts, comes to the driver. Lengths are placed longest first; equal containers
are one run of container numbers with one free room, so placing a length updates counts of patterns, not containers.
The result, segments (length, first rank, first container, count), is bounded by the capacity, whatever the number of
documents; documents find their container by their rank among those of their length.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.operators.prefix import hash_bucket, running_total
from codequarry.session import cut

#: About so many rows of one length are ranked by one task.
ROWS = 200_000


def pack_histogram(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """([(length, first rank, first container, count)], number of containers) for lengths 1..capacity.

    A length goes to the emptiest containers that have room (the shortest packs). Where none has, new containers are
    opened that hold as many of the length as fit.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # free room -> runs (first container, how many)
    heap: list[int] = []  # negative rooms that may have runs
    segments: list[tuple[int, int, int, int]] = []
    total = 0

    def put(free: int, start: int, n: int) -> None:
        if free > 0 and n > 0:
            if free not in room:
                room[free] = []
                heapq.heappush(heap, -free)
            room[free].append((start, n))

    for length in sorted((x for x in counts if counts[x] > 0), reverse=True):
        left, rank = counts[length], 0
        while left:
            while heap and not room.get(-heap[0]):
                room.pop(-heapq.heappop(heap), None)
            if heap and -heap[0] >= length:
                free = -heap[0]
                start, n = room[free].pop()
                k = min(n, left)
                segments.append((length, rank, start, k))
                put(free - length, start, k)
                put(free, start + k, n - k)
                rank, left = rank + k, left - k
                continue
            each = capacity // length
            full, rest = divmod(left, each)
            for _ in range(each if full else 0):
                segments.append((length, rank, total, full))
                rank += full
            put(capacity - each * length, total, full)
            total += full
            if rest:
                for _ in range(rest):
                    segments.append((length, rank, total, 1))
                    rank += 1
                put(capacity - rest * length, total, 1)
                total += 1
            left = 0
    return segments, total


def fill_containers(sizes: DataFrame, *, key: str, size: str, capacity: int = 2048) -> DataFrame:
    """(key, piece, start, size, container): every item of a positive size, in containers numbered from 0.

    An item above the capacity is cut into full pieces and a rest (piece numbers from 0, ``start`` = tokens before the
    piece); others are never split. Items of size 0 or null take no room and have no row. Keys need not be unique: equal
    rows are packed one by one. Items of one length follow a hash of their key, so the result does not depend on how the
    table is stored.
    """
    items = cut(sizes.select(F.col(key).alias("k"), F.col(size).cast("long").alias("n")).filter("n > 0"))
    full, rest = F.floor(F.col("n") / capacity), (F.col("n") % capacity).cast("int")
    histogram = {r["len"]: r["c"] for r in items.filter(rest > 0).groupBy(rest.alias("len")).agg(F.count(F.lit(1)).alias("c")).collect()}
    whole = items.agg(F.sum(full).alias("n"), F.count_if(full > 0).alias("items")).first()
    # buckets by the length with the most rows, so that none holds more than about ROWS of them
    bits = min(24, max(1, (max([*histogram.values(), whole["items"], 1]) // ROWS).bit_length() + 1))
    bucket, order = hash_bucket("k", bits=bits)
    hashed = items.withColumn("full", full).withColumn("len", rest).withColumn("__b", bucket).withColumn("__o", order)
    # a full piece is a container: its items count how many lie before them, whatever their number
    before = running_total(hashed.filter("full > 0"), [], "__b", ["__o", "k", "n"], F.col("full"), "before")
    filled = before.select("k", "before", F.explode(F.sequence(F.lit(0), (F.col("full") - 1).cast("int"))).alias("piece")).select(
        "k", "piece", (F.col("piece").cast("long") * capacity).alias("start"), F.lit(capacity).alias("size"), (F.col("before") + F.col("piece")).alias("container")
    )
    taken = int(whole["n"] or 0)
    segments, _ = pack_histogram(histogram, capacity)
    seg = np.array(segments, dtype=np.int64).reshape(-1, 4)
    seg = seg[np.lexsort((seg[:, 1], seg[:, 0]))]
    shift = 44
    table = items.sparkSession.sparkContext.broadcast(((seg[:, 0] << shift) | seg[:, 1], seg[:, 1], seg[:, 2] + taken))
    ranked = running_total(hashed.filter("len > 0"), ["len"], "__b", ["__o", "k", "n"], F.lit(1), "rank")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, first, container = table.value
        for pdf in batches:
            rank = pdf["rank"].to_numpy(np.int64)
            i = np.searchsorted(at, (pdf["len"].to_numpy(np.int64) << shift) | rank, side="right") - 1
            yield pd.DataFrame({"k": pdf["k"], "piece": pdf["piece"], "start": pdf["start"], "size": pdf["len"], "container": container[i] + rank - first[i]})

    kind = items.schema["k"].dataType.simpleString()
    rests = ranked.select("k", F.col("full").cast("int").alias("piece"), (F.col("full") * capacity).alias("start"), "len", "rank")
    out = filled.unionByName(rests.mapInPandas(place, f"k {kind}, piece int, start long, size int, container long"))
    return out.withColumnRenamed("k", key)


def usage(filled: DataFrame, *, capacity: int = 2048) -> DataFrame:
    """(containers, items, tokens, unused_share): one row."""
    per = filled.groupBy("container").agg(F.sum("size").alias("t"), F.count(F.lit(1)).alias("c"))
    return per.agg(F.count(F.lit(1)).alias("containers"), F.sum("c").alias("items"), F.sum("t").alias("tokens"), F.max("t").alias("fullest")).withColumn(
        "unused_share", F.round(1 - F.col("tokens") / (F.col("containers") * capacity), 6)
    )
