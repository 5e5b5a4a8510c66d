import random

import pytest
from pyspark.sql import functions as F

from lexwarden.llm import components as C


def union_find(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("seed", range(3))
def test_against_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(60):03}", f"n{rng.randrange(60):03}") for _ in range(45)]
    edges += [(f"p{i:03}", f"p{i + 1:03}") for i in range(40)]  # a long path
    edges += [("hub", f"z{i:03}") for i in range(30)]
    got = {r.node: r.component for r in C.components(spark.createDataFrame(edges + edges[:5] + [(None, "x")], "a string, b string")).collect()}
    want = union_find([e for e in edges if e[0] != e[1]])
    assert got == want


def test_entities(spark):
    rows = [(1, "a", None), (2, "a", "x"), (3, "b", "x"), (4, None, None), (5, "c", "y"), (6, None, "y"), (6, None, "y")]
    df = spark.createDataFrame(rows, "row_key long, component string, node string")
    got = [tuple(r) for r in C.entity_components(df, "row_key", [F.col("component"), F.col("node")]).collect()]
    by = dict(got)
    assert len(got) == 7 and by[1] == by[2] == by[3] != by[5] == by[6] and by[4] not in (by[1], by[5])
    assert C.entity_components(df.limit(0), "row_key", [F.col("node")]).count() == 0


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("ng3-54", "ng3-000000054", True), ("NG3_000000054", " ng3 000000054\t", True), ("ng3000000054", "ng3:54", True), ("ng3-000000054.de", "ng3-000000054/FR", True), ("ng3-54", "ng3-540", False),
        ("gard-54", "ng3-54", False), ("ng3-seedbank", "ng3-seedbank", True), ("ng3-seedbank", "ng3-0", False), ("a" * 64, "A" * 64, True), ("ab12" * 5, "ab13" * 5, False), ("ng3-000000054-zh-CN", "ng3-54", True),
        ("sgm000000000", "sgm-0", True),
    ],
)
def test_source_keys(spark, a, b, same):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(C.source_key(F.col("a")), C.source_key(F.col("b"))).first()
    assert (row[0] == row[1]) is same


def test_splits(spark):
    rows = [(i, f"s{i // 3}") for i in range(3000)]
    members = C.entity_components(spark.createDataFrame(rows, "row_key long, s string"), "row_key", [F.col("s")])
    targets = spark.createDataFrame([("train", 0.8), ("valid", 0.08), ("test", 0.12)], "split_name string, share double")
    assigned = C.assign_splits(members, targets)
    assert assigned.groupBy("component").agg(F.countDistinct("assigned_split").alias("n")).where("n > 1").count() == 0
    report = {r.assigned_split: r for r in C.split_report(assigned, targets).collect()}
    assert sum(r.n_rows for r in report.values()) == 3000
    assert all(abs(r.realised_share - r.target_share) < 0.04 for r in report.values())
    with pytest.raises(ValueError, match="negative"):
        C.read_shares(spark.createDataFrame([("a", -1.0)], "split_name string, share double"))


def test_heavy_components_go_first(spark):
    rows = [(i, "hot") for i in range(1100)] + [(10_000 + i, f"big{i % 7}") for i in range(900)] + [(20_000 + i, f"s{i // 2}") for i in range(8000)]
    members = C.entity_components(spark.createDataFrame(rows, "row_key long, heavy_split string"), "row_key", [F.col("heavy_split")])
    targets = spark.createDataFrame([("train", 0.8), ("valid", 0.08), ("test", 0.12)], "split_name string, share double")
    assigned = C.assign_splits(members, targets)
    assert assigned.count() == 10_000 and assigned.groupBy("component").agg(F.countDistinct("assigned_split").alias("n")).where("n > 1").count() == 0
    assert all(abs(r.realised_share - r.target_share) < 0.01 for r in C.split_report(assigned, targets).collect())
    placed, left = C.place_heavy({"a": 0.7, "b": 0.3}, [("x", 0.9), ("y", 0.05)])
    assert placed == {"x": "a", "y": "b"} and left == {"a": 0.0, "b": 1.0}


def test_linked_query_against_union_find(spark, sf_dir):
    from collections import Counter

    from lexwarden.llm import queries as Q
    from lexwarden.session import table

    rows = table(spark, sf_dir, "canonical_examples").select("row_id", C.source_key(F.col("source_id")).alias("k"), F.sha2("prompt", 256).alias("p")).collect()
    root = union_find([(f"r{r.row_id}", f"{n}{v}") for r in rows for n, v in (("k", r.k), ("p", r.p)) if v is not None])
    want = Counter(Counter(root.get(f"r{r.row_id}", f"r{r.row_id}") for r in rows).values())
    assert {r.n_rows: r.n_components for r in Q.p5_linked(spark, sf_dir).collect()} == want


def test_scattered(spark):
    rows = [(1, "a", "x", "train"), (2, "a", None, "test"), (3, "b", None, "train"), (4, "b", None, "train"), (5, None, "x", "train"), (6, None, None, "test"), (7, "c", None, None), (8, "c", None, "test")]
    df = spark.createDataFrame(rows, "row_key long, anchor string, component string, split string")
    assert sorted(r.row_key for r in C.scattered_rows(df, "row_key", [F.col("anchor"), F.col("component")], "split").collect()) == [1, 2, 5, 7, 8]
