import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexwarden.llm import quotas as Q

TARGETS = "target_id long, plan string, pool_table string, language string, view string, subset string, share double, min_rows long, sample_size long"


def test_flow_against_enumeration():
    rng = random.Random(5)
    for _ in range(30):
        supply, caps = [rng.randrange(4) for _ in range(2)], [rng.randrange(4) for _ in range(3)]
        cost = [[rng.randrange(5) for _ in caps] for _ in supply]
        net = Q.FlowNetwork(7)
        for i, s in enumerate(supply):
            net.arc(0, 2 + i, s, 0)
            for j in range(3):
                net.arc(2 + i, 4 + j, 9, cost[i][j])
        for j, c in enumerate(caps):
            net.arc(4 + j, 1, c, 0)
        best = None
        for x in itertools.product(range(4), repeat=6):
            rows, cols = (sum(x[:3]), sum(x[3:])), [x[j] + x[3 + j] for j in range(3)]
            if all(r <= s for r, s in zip(rows, supply)) and all(v <= c for v, c in zip(cols, caps)):
                key = (-sum(x), sum(v * cost[k // 3][k % 3] for k, v in enumerate(x)))
                best = key if best is None or key < best else best
        sent, paid = net.run(0, 1)
        assert (-sent, paid) == best


def test_random_quotas():
    seen = Counter()
    for seed in range(400):
        got = Q.random_quotas(5, {0: 3, 1: 10, 2: 7}, random.Random(seed))
        assert sum(got.values()) == 5 and all(got[j] <= n for j, n in {0: 3, 1: 10, 2: 7}.items())
        seen.update(got)
    for j, n in {0: 3, 1: 10, 2: 7}.items():
        assert abs(seen[j] / 400 - 5 * n / 20) < 0.12
    assert Q.random_quotas(3, {0: 1, 1: 2}, random.Random(0)) == {0: 1, 1: 2}
    assert Q.random_quotas(0, {0: 1}, random.Random(0)) == {0: 0} and Q.random_quotas(2, {}, random.Random(0)) == {}


def pool_of(spark, counts, extra=()):
    rows = [(f"{lang}{view}{i}", lang, view, None, "x", 1) for (lang, view), n in counts.items() for i in range(n)]
    return Q.pool(spark.createDataFrame(rows + list(extra), "example_id string, language string, view string, subset string, plan string, n long"), "predictions")


def test_sample(spark):
    dirt = [("enP0", "en", "P", None, "x", 1), (None, "en", "P", None, "x", 1), ("q", None, "P", None, "x", 1), ("zhP0", "zh-CN", "P", None, "x", 1)]
    pools = pool_of(spark, {("en", "P"): 60, ("en", "PR"): 40, ("zh", "P"): 3, ("fr", "P"): 30}, dirt)
    targets = spark.createDataFrame(
        [(1, "a", "predictions", "en", None, None, 0.5, 5, 40), (2, "a", "predictions", "zh", None, None, 0.3, 5, 40), (3, "a", "predictions", "fr", None, None, 0.2, 5, 40), (4, "a", "predictions", "ko", None, None, 0.0, 2, 40)], TARGETS
    )
    assert {r.target_id: r.available for r in Q.available(pools, targets).collect()} == {1: 100, 2: 3, 3: 30, 4: 0}
    assert sorted(r.target_id for r in Q.short_targets(pools, targets).collect()) == [2, 4]
    sample, report = Q.draw_sample(pools, targets)
    rows = sample.collect()
    assert len(rows) == len({r.example_id for r in rows}) == 40
    drawn = Counter(r.language for r in rows)
    assert drawn["zh"] == 3 and drawn["en"] > 20 and drawn["fr"] > 8
    by = {r.target_id: r for r in report.collect()}
    assert not by[2].met and not by[4].met and by[1].met and by[1].drawn == drawn["en"] and by[2].missing == 9
    assert {r.example_id for r in Q.draw_sample(pools, targets)[0].collect()} == {r.example_id for r in rows}
    views = Counter(r.view for r in rows if r.language == "en")
    assert abs(views["P"] - drawn["en"] * 0.6) <= 1


def test_floors_and_exact_shares(spark):
    pools = pool_of(spark, {("en", "P"): 500, ("fr", "P"): 50, ("de", "P"): 50})
    targets = spark.createDataFrame([(1, "a", "predictions", "en", "P", None, 0.96, 1, 100), (2, "a", "predictions", "fr", "P", None, 0.03, 10, 100), (3, "a", "predictions", "de", "P", None, 0.01, 10, 100)], TARGETS)
    drawn = Counter(r.language for r in Q.draw_sample(pools, targets)[0].collect())
    assert drawn == {"en": 80, "fr": 10, "de": 10}


def test_targets_that_compete_for_a_cell_are_reported(spark):
    pools = pool_of(spark, {("ar", "P"): 60})
    targets = spark.createDataFrame([(1, "a", "predictions", "ar", None, None, 0.5, 1, 100), (2, "a", "predictions", None, "P", None, 0.5, 1, 100)], TARGETS)
    sample, report = Q.draw_sample(pools, targets)
    by = {r.target_id: r for r in report.collect()}
    assert sample.count() == by[1].drawn + by[2].drawn == 60
    assert all(r.met and r.missing == 0 and r.contested == 50 - r.drawn for r in by.values()) and by[1].contested + by[2].contested == 40
    alone = Q.draw_sample(pools, targets.where("target_id = 1"))[1].first()
    assert alone.contested == 0 and alone.drawn == 50


def test_an_example_in_two_cells_serves_either_target(spark):
    rows = [(f"e{i}", lang, "P", None) for i in range(22) for lang in (("de", "fr") if i < 14 else ("fr",))]
    pools = Q.pool(spark.createDataFrame(rows, "example_id string, language string, view string, subset string"), "predictions")
    targets = spark.createDataFrame([(1, "a", "predictions", "de", None, None, 0.2, 1, 25), (2, "a", "predictions", "fr", None, None, 0.8, 1, 25)], TARGETS)
    sample, report = Q.draw_sample(pools, targets)
    by = {r.target_id: r for r in report.collect()}
    assert by[1].available == 14 and by[2].available == 22 and by[1].drawn + by[2].drawn == 22 == sample.count()
    assert by[2].met and by[2].missing == 0 and by[1].contested + by[2].contested == 3
    assert [r.target_id for r in Q.short_targets(pools, targets).collect()] == []


def test_empty(spark):
    pools = pool_of(spark, {("en", "P"): 1}).limit(0)
    targets = spark.createDataFrame([(1, "a", "predictions", "en", None, None, 1.0, 5, 10)], TARGETS)
    sample, report = Q.draw_sample(pools, targets)
    assert sample.count() == 0 and not report.first().met
    assert Q.draw_sample(pools, targets.limit(0))[1].count() == 0
    with pytest.raises(ValueError, match="more than"):
        Q.read_targets(spark.range(Q.MAX_TARGETS + 1).select(F.col("id").alias("target_id"), *[F.lit(None).cast(t).alias(c) for c, t in [x.split() for x in TARGETS.split(", ")[1:]]]))
