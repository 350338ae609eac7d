"""The search for weights: right against a plain count of ranks, and small in what it moves."""

import math
import random

import pytest

from codequarry.operators import evaluate
from codequarry.plans import catalogue

TINY = "/root/testdata/sf0.001"


def shuffled(spark):
    """Bytes written to shuffles so far."""
    sc = spark.sparkContext
    it = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList()).iterator()
    n = 0
    while it.hasNext():
        n += it.next().shuffleWriteBytes()
    return n


def plain(rows, truth, formulas):
    """Scores by sorting each group, missing scores last and NaN first, equal ones by item."""
    out = {}
    for name, *w, penalty in formulas:
        per = []
        for g in sorted({r[0] for r in rows}):

            def key(r):
                s = None if None in r[2:7] else r[2] * w[0] + r[3] * w[1] + r[4] * w[2] + r[5] * w[3] + r[6] * w[4] - (penalty if r[7] else 0)
                s = s if s is None or math.isnan(s) else math.copysign(math.floor(abs(s) * 1e9 + 0.5) / 1e9, s)
                return (2, 0, r[1]) if s is None else (0, 0, r[1]) if math.isnan(s) else (1, -s, r[1])

            order = sorted((r for r in rows if r[0] == g), key=key)
            at = [k for k, r in enumerate(order) if (g, r[1]) in truth]
            if at and len(order) > 1:
                per.append(math.floor((1 - sum(at) / (len(at) * (len(order) - 1))) * 1000 + 0.5))
        if per:
            out[name] = math.floor(sum(per) / len(per) + 0.5) / 1000
    return out


@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("chunk", [500_000, 3])
def test_grid_equals_a_plain_count(spark, chunk, big):
    rnd = random.Random(5)
    value = lambda: rnd.choice([0.0, 0.25, 0.5, 1.0, rnd.random()])
    rows = [(g, i, *(value() for _ in range(5)), rnd.choice([True, False, None])) for g, n in (("a", 1), ("b", 2), ("c", 9), ("d", 40), ("e", 25)) for i in rnd.sample(range(100), n)]
    rows += [("c", 200 + i, None if i % 2 else 0.5, 0.0, 0.0, 1.0, 0.0, False) for i in range(5)]
    if big:
        rows += [("d", 300, float("nan"), 0.0, 0.0, 0.0, 0.0, False), ("d", 301, 1e12, 0.0, 0.0, 0.0, 0.0, True), ("d", 302, None, 0.0, 0.0, 0.0, 0.0, True)]
    truth = {(r[0], r[1]) for r in rows if rnd.random() < 0.3 or r[1] >= 300} - {(r[0], r[1]) for r in rows if r[0] == "e"}
    formulas = [(k, *map(float, v)) for k, v in evaluate.NAMED.items()]
    kinds = ", ".join(f"{c} double" for c in evaluate.SIGNALS)
    f = spark.createDataFrame(rows, f"repo string, item long, {kinds}, private boolean")
    t = spark.createDataFrame(sorted(truth), "repo string, item long")
    grid = spark.createDataFrame(formulas, f"variant string, {kinds}, penalty double")
    got = evaluate.grid_search(f, t, grid, by="repo", item="item", limit=None, chunk=chunk).collect()
    assert {r.variant: r.score for r in got} == plain(rows, truth, formulas)


def test_grid_without_hits(spark):
    f = spark.createDataFrame([], "repo string, item long, centrality double, reverse double, fan_in double, churn double, size double, private boolean")
    t = spark.createDataFrame([], "repo string, item long")
    assert evaluate.grid_search(f, t, evaluate.variants(spark), by="repo", item="item").collect() == []


@pytest.mark.parametrize("name, n", [("eval_variant_rank", 3403), ("topk_variants", 12), ("eval_grid", 3403)])
def test_the_grid_moves_its_features_only(spark, name, n):
    began = shuffled(spark)
    assert len(catalogue.QUERIES[name](spark, TINY).collect()) == n
    assert shuffled(spark) - began < 1_000_000
