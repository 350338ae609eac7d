"""Long exact spans shared between records: recurring passages confirmed, located by sharded Aho-Corasick automata.

1. Every text is winnowed: of each run of ``length`` characters at least one anchor (a substring of ``ANCHOR``
   characters) is selected by its hash alone, so two texts that share a run of ``length`` share a selected anchor.
2. Anchors found in two or more records are the recurring passages. Only they go on, with their records.
3. The passages are sharded by the texts that hold them: a shard is some texts and all recurring passages that were
   selected in them, read off the texts themselves. An Aho-Corasick automaton is compiled per shard and its texts are
   streamed through it, each text once, however many passages there are; that gives every occurrence with its surroundings.
4. Occurrences of one passage with the same surroundings are one class. Two classes share a long run iff their common
   extension to the left and right reaches ``length``. Few classes are compared directly; many are matched by the exact
   runs themselves, as an equi-join, so no group is ever expanded into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.session import cut

#: Anchor length is half the run; the winnowing window is the rest, so that anchor + window - 1 = length.
MULT = np.uint64(0x9E3779B97F4A7C15)


def _hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k-gram, by doubling: h(2m at i) mixes h(m at i) with h(m at i + m)."""
    h = (codes.astype(np.uint64) + np.uint64(0x1F3D5B79)) * MULT
    h ^= h >> np.uint64(29)
    m, bit = 1, k.bit_length() - 2
    base = h
    while bit >= 0:
        h = (h[:-m] * np.uint64(0xBF58476D1CE4E5B9)) ^ (h[m:] + MULT)
        h ^= h >> np.uint64(31)
        m *= 2
        if k >> bit & 1:
            h = (h[:-1] * np.uint64(0x94D049BB133111EB)) ^ base[m : m + len(h) - 1]
            h ^= h >> np.uint64(28)
            m += 1
        bit -= 1
    return h * MULT


#: Bits of a position within a block; the rest of the sort key is hash. Blocks are cut so that arrays stay in cache.
BITS = 22
BLOCK = 150_000
LONG = 2_000_000


def _winnow_block(texts: list[str], k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, position, hash) of the least k-gram of each window of w k-grams of each text.

    The key of a k-gram is its hash in the high bits and its distance from the block's end in the low ones: a sliding
    minimum then yields place and hash at once, and settles ties by taking the rightmost, whatever the surroundings.
    Windows that reach over the end of a text are left out. Blocks hold fewer than 2^BITS characters.
    """
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    h = _hashes(codes, k)
    mask = np.uint64((1 << BITS) - 1)
    key = (h & ~mask) | (mask - np.arange(len(h), dtype=np.uint64))
    low, m = key, 1
    while 2 * m <= w:
        low = np.minimum(low[: len(low) - m], low[m:])
        m *= 2
    n = len(h) - w + 1
    low = np.minimum(low[:n], low[w - m : w - m + n])
    ends = np.cumsum(lens)
    starts = ends - lens
    valid = np.zeros(n + 1, np.int8)
    np.add.at(valid, starts, 1)
    np.add.at(valid, np.minimum(ends - (w + k - 2), n), -1)
    at = (mask - (low[np.cumsum(valid[:n], dtype=np.int8) > 0] & mask)).astype(np.int64)
    at = at[np.r_[True, at[1:] != at[:-1]]]
    doc = np.searchsorted(ends, at, side="right")
    return doc, at - starts[doc], h[at]


def _blocks(ids: list[int], texts: list[str], reach: int) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """(ids, offsets, texts) of about BLOCK characters. A longer text comes in parts that overlap by ``reach``, the
    length of a window less one, so that each of its windows lies within a part; shorter ones stay whole."""
    some: tuple[list[int], list[int], list[str]] = ([], [], [])
    size = 0
    for i, whole in zip(ids, texts):
        for at in range(0, max(1, len(whole) - reach), LONG):
            t = whole[at : at + LONG + reach] if len(whole) > LONG + reach else whole
            if some[0] and size + len(t) > BLOCK:
                yield some
                some, size = ([], [], []), 0
            some[0].append(i)
            some[1].append(at)
            some[2].append(t)
            size += len(t)
            if t is whole:
                break
    if some[0]:
        yield some


def shared_spans(df: DataFrame, *, key: str, text: str, length: int = 200, shard_chars: int = 2_000_000, few: int = 48) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, coverage, passages) of records whose texts share a run of ``length`` or more identical characters.

    pairs(id_a, id_b): id_a < id_b, once each, complete. coverage(id, n_chars, shared_chars, share): every record with
    a non-null text; shared_chars counts the characters that lie in some run also found in another record.
    passages(passage, id, pos): every place of every recurring anchor. Null texts are left out of all three, texts
    shorter than ``length`` share nothing; rows of one key and text count once. Characters are Unicode code points.
    """
    k = max(2, length // 2)
    w = length - k + 1
    src = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).dropna()
    long_enough = src.filter(F.char_length("t") >= length)

    def anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for some, offsets, texts in _blocks(pdf["id"].tolist(), pdf["t"].tolist(), length - 1):
                doc, pos, h = _winnow_block(texts, k, w)
                yield pd.DataFrame({"id": np.asarray(some, np.int64)[doc], "pos": (pos + np.asarray(offsets, np.int64)[doc]).astype(np.int32), "h": h.view(np.int64)})

    # written once: a few bytes per 50 characters, against reading and hashing every text a second time
    occ = cut(long_enough.mapInPandas(anchors, "id long, pos int, h long"))
    recurring = cut(occ.groupBy("h").agg(F.min("id").alias("x"), F.max("id").alias("y")).filter("x <> y").select("h"))
    n_passages = recurring.count()
    hits = occ.join(recurring.select("h"), "h", "left_semi").groupBy("id").agg(F.sort_array(F.collect_list("pos")).alias("hits"))
    docs = hits.join(long_enough, "id")

    def shard(ids: list[int], texts: list[str], places: list[np.ndarray]) -> pd.DataFrame:
        auto = ahocorasick.Automaton()
        for t, ps in zip(texts, places):
            for at in ps:
                p = t[at : at + k]
                if len(p) == k:
                    auto.add_word(p, p)
        auto.make_automaton()
        out = []
        for i, t in zip(ids, texts):
            for end, p in auto.iter(t):
                at = end - k + 1
                out.append((p, i, at, t[max(0, at - w + 1) : at], t[end + 1 : end + w]))
        return pd.DataFrame(out, columns=["phrase", "id", "pos", "l", "r"])

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lo = size = 0
            lens = pdf["t"].str.len().tolist()
            for j, n in enumerate(lens):
                size += n
                if size >= shard_chars or j == len(lens) - 1:
                    part = pdf.iloc[lo : j + 1]
                    yield shard(part["id"].tolist(), part["t"].tolist(), part["hits"].tolist())
                    lo, size = j + 1, 0

    found = docs.mapInPandas(stream, "phrase string, id long, pos int, l string, r string")
    sep = F.lit("\x00")
    found = cut(found.withColumn("cls", F.substring(F.sha2(F.concat("phrase", sep, "l", sep, "r"), 256), 1, 32)).withColumn("passage", F.expr("conv(substr(sha2(phrase, 256), 1, 15), 16, 10)").cast("long")))
    classes = cut(found.groupBy("cls", "phrase", "l", "r").agg(F.min("passage").alias("passage"), F.min("id").alias("x"), F.max("id").alias("y")))
    members = found.select("cls", "id", "pos").distinct()
    sizes = classes.groupBy("phrase").agg(F.count(F.lit(1)).alias("n_cls"))
    sized = classes.join(sizes, "phrase")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(pdf["phrase"], (x[::-1] for x in pdf["l"]), pdf["r"], pdf["cls"]), key=lambda x: x[0])
        out, lo = [], 0
        for j, (phrase, left, right, cls) in enumerate(rows):
            if rows[lo][0] != phrase:
                lo = j
            for _, l2, r2, c2 in rows[lo:j]:
                a, b = _common(left, l2), _common(right, r2)
                if a + b + k >= length:
                    out.append((cls, c2, a, b))
        return pd.DataFrame(out, columns=["c1", "c2", "a", "b"])

    parts = max(1, n_passages // 3_000)
    direct = sized.filter((F.col("n_cls") > 1) & (F.col("n_cls") <= few)).groupBy(F.pmod(F.xxhash64("phrase"), F.lit(parts))).applyInPandas(compare, "c1 string, c2 string, a int, b int")
    # many classes: every run of exactly `length` around the passage is a key, with a = its part to the left
    ll, rl = F.char_length("l"), F.char_length("r")
    runs = (
        sized.filter(F.col("n_cls") > few)
        .withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(w - 1))))
        .filter((F.col("a") <= ll) & (w - 1 - F.col("a") <= rl))
        .select("cls", "a", F.col("passage"), F.sha2(F.concat("phrase", F.lit("\x00"), F.expr("right(l, a)"), F.lit("\x00"), F.substring(F.col("r"), F.lit(1), w - 1 - F.col("a"))), 256).alias("run"))
    )
    runs = cut(runs)
    r1, r2 = runs.select(F.col("cls").alias("c1"), "a", "run"), runs.select(F.col("cls").alias("c2"), "run")
    big_pairs = r1.join(r2, "run").filter("c1 < c2").select("c1", "c2").distinct()
    own = classes.filter("x <> y").select(F.col("cls").alias("c1"), F.col("cls").alias("c2"), F.char_length("l").alias("a"), F.char_length("r").alias("b")).filter(F.col("a") + F.col("b") + k >= length)
    direct = cut(direct.unionByName(own))
    links = direct.select("c1", "c2").union(big_pairs)
    m1, m2 = members.select(F.col("cls").alias("c1"), F.col("id").alias("i1")).distinct(), members.select(F.col("cls").alias("c2"), F.col("id").alias("i2")).distinct()
    pairs = links.join(m1, "c1").join(m2, "c2").filter("i1 <> i2").select(F.least("i1", "i2").alias("id_a"), F.greatest("i1", "i2").alias("id_b")).distinct()
    twice = runs.groupBy("run").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("run")
    from_runs = runs.join(twice, "run").select(F.col("cls"), F.col("a"), (w - 1 - F.col("a")).alias("b"))
    extents = direct.select(F.col("c1").alias("cls"), "a", "b").union(direct.select("c2", "a", "b")).union(from_runs).distinct()
    spans = members.join(extents, "cls").select("id", (F.col("pos") - F.col("a")).alias("s"), (F.col("pos") + k + F.col("b")).alias("e")).distinct()

    # united intervals: what a span adds lies beyond the furthest end before it
    before = Window.partitionBy("id").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    new = spans.withColumn("hi", F.coalesce(F.max("e").over(before), F.lit(-1))).select("id", F.greatest(F.lit(0), F.col("e") - F.greatest("s", "hi")).alias("n"))
    covered = new.groupBy("id").agg(F.sum("n").alias("part"))
    whole = F.coalesce("part", F.lit(0))
    coverage = src.select("id", F.char_length("t").alias("n_chars")).distinct().join(covered, "id", "left").select("id", "n_chars", whole.alias("shared_chars"), F.when(F.col("n_chars") > 0, whole / F.col("n_chars")).otherwise(0.0).alias("share"))
    return pairs, coverage, found.select("passage", "id", "pos")


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo
