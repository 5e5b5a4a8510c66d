import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexwarden.operators import canonical, metrics, quality, ranking, sampling, scoring, windows

RAW = "raw_id long, source_path string, source_line long, id string, prompt string, response string, prompt_label string, response_label string, language string, violated_categories string"


def raw(spark, *rows):
    return spark.createDataFrame([(i, "in/zh/train.jsonl", i, *r) for i, r in enumerate(rows, 1)], RAW)


def test_views(spark):
    df = raw(
        spark,
        ("a", "p", "r", "Safe", "unsafe", "en", "x, y"), ("b", "p", "r", "maybe", "safe", "", None), ("c", "p", None, "safe", "safe", "zh-CN", None), ("d", "", "r", "safe", "safe", "en", None),
        ("", "p", "", "unsafe", "safe", "en", None), ("e", "p", "r", " safe", None, "en", None), ("f", "p", "r", "safe", "safe", "ko", None), (None, None, None, None, None, None, None),
    )
    got = {(r.raw_id, r.view): r for r in canonical.canonical_views(df, keep=("raw_id",)).collect()}
    assert set(got) == {(1, "P"), (1, "PR"), (2, "PR"), (3, "P"), (5, "P")}
    assert got[1, "PR"].category_scope == "interaction" and got[1, "PR"].categories == ["x", "y"]
    assert got[2, "PR"].prompt_safety_label == "safe" and got[2, "PR"].language == "zh"
    assert got[1, "P"].text == "Prompt: p" and got[1, "PR"].text == "Prompt: p\nResponse: r"
    assert len(got[5, "P"].source_id) == 64
    assert canonical.contract(canonical.canonical_views(df)).columns[0] == "example_id"
    assert canonical.canonical_views(df.limit(0)).count() == 0


def test_sea_and_csv(spark):
    rows = spark.createDataFrame([("f", 1, [("p", "r")], "safe", "harmful")], "source_path string, source_line long, prompts array<struct<prompt_text string, response_text string>>, prompt_label string, response_label string")
    got = canonical.sea_rows(rows, "general", "rev", ["safeguard_general_prompt"]).orderBy("view").collect()
    assert [(r.example_id, r.safety_label, r.registered_in_pinned_seahelm_vi_suite) for r in got] == [("sea:general:0001:P:vi", "safe", True), ("sea:general:0001:PR:vi", "unsafe", False)]
    with pytest.raises(Exception, match="empty text"):
        canonical.sea_rows(rows.withColumn("prompts", F.expr("filter(prompts, x -> false)")), "general", "rev").collect()
    got = canonical.csv_rows(spark.createDataFrame([("en", "cat.csv", 2, "p")], "language string, file_name string, record_no long, prompt string")).first()
    assert got.categories == ["cat"] and got.safety_label == "unsafe" and len(got.source_id) == 20


def test_first_wins_and_checks(spark):
    df = spark.createDataFrame([(1, "a", "train"), (2, "a", "test"), (3, None, "train"), (4, None, "train"), (5, "b", "train")], "row_id long, k string, source_split string")
    kept = quality.first_wins(df, ["k"], ["row_id"], ["row_id"])
    assert sorted(r.row_id for r in kept.collect()) == [1, 3, 5]
    assert sorted(r.row_id for r in quality.first_wins(kept, ["k"], ["row_id"], ["row_id"]).collect()) == [1, 3, 5]
    assert [tuple(r) for r in quality.split_overlap_counts(df, ["k"]).collect()] == [("test", "train", 1)]
    with pytest.raises(ValueError, match="leakage"):
        quality.check_no_leakage(df, ["k"])
    quality.check_no_leakage(df.where("row_id <> 2"), ["k"])
    with pytest.raises(ValueError, match="expected 3"):
        quality.check_row_count(df, 3)
    assert quality.check_row_count(df, 0) == 5
    with pytest.raises(ValueError, match="missing fields: view"):
        quality.check_required_fields(df, ("k", "view"))
    with pytest.raises(ValueError, match="not unique"):
        quality.check_unique(df, "k")
    quality.check_unique(df, "row_id")
    with pytest.raises(ValueError, match="unsupported view"):
        quality.check_views(spark.createDataFrame([("P",), ("R",)], "view string"))
    with pytest.raises(ValueError, match="blank"):
        quality.check_not_blank(spark.createDataFrame([("　",)], "t string"), "t")
    grid = quality.missing_grid(spark.createDataFrame([("en", "train")], "language string, split string"), ["en"], ["train", "test"])
    assert [tuple(r) for r in grid.collect()] == [("en", "test")]


def brute_sample(rows, n):
    """Allocation and sizes per stratum by a plain loop over strata in order of arrival."""
    strata = {}
    for r in rows:
        strata.setdefault(r[1], []).append(r)
    sizes, total = {}, 0
    for k, members in strata.items():
        take = min(max(1, round(n * len(members) / len(rows))), len(members))
        take = max(0, min(take, n - total))
        sizes[k], total = take, total + take
    return sizes, total


@pytest.mark.parametrize(("sizes", "n"), [((50, 30, 20), 10), ((5, 5, 90), 7), ((1, 1, 1, 97), 3), ((10, 1), 100), ((33, 33, 34), 10)])
def test_sample(spark, sizes, n):
    rows = [(i, f"s{k}") for i, k in enumerate(k for k, size in enumerate(sizes) for _ in range(size))]
    got = sampling.stratified_sample(spark.createDataFrame(rows, "id long, s string"), ["s"], n, "id", "id").collect()
    want, total = brute_sample(rows, n)
    assert len(got) == len({r.id for r in got}) == min(n, len(rows))
    for k, size in want.items():
        assert sum(r.s == k for r in got) >= size
    if total == n:
        assert {k: sum(r.s == k for r in got) for k in want} == want
    assert sampling.stratified_sample(spark.createDataFrame([], "id long, s string"), ["s"], n, "id", "id").count() == 0


def test_limits(spark):
    df = spark.range(5)
    assert [sampling.ordered_limit(df, ["id"], n).count() for n in (None, 0, 3)] == [5, 0, 3]
    assert sampling.remaining(df, df.limit(2), "id").count() == 3


PRED = "benchmark string, language string, view string, subset string, gold string, prediction string, prediction_for_metrics string"


def test_measures_by_hand(spark):
    rows = [("b", "en", "P", None, g, p, p) for g, p in [("unsafe", "unsafe")] * 3 + [("unsafe", "safe")] + [("safe", "unsafe")] * 2 + [("safe", "safe")] * 4] + [("b", "en", "P", None, "safe", None, "unsafe")]
    got = {tuple(r)[:4]: r for r in metrics.guard_metrics(spark.createDataFrame(rows, PRED)).collect()}
    assert set(got) == {("b", "ALL", "ALL", "ALL"), ("b", "en", "ALL", "ALL"), ("b", "en", "P", "ALL")}
    r = got["b", "en", "P", "ALL"]
    assert (r.examples, r.parsed, r.tp, r.fn, r.fp, r.tn) == (11, 10, 3, 1, 3, 4)
    assert math.isclose(r.accuracy, 7 / 11, abs_tol=1e-6) and math.isclose(r.unsafe_f1, 6 / 10, abs_tol=1e-6)
    assert math.isclose(r.macro_f1, (6 / 10 + 8 / 12) / 2, abs_tol=1e-6) and math.isclose(r.balanced_accuracy, (3 / 4 + 4 / 7) / 2, abs_tol=1e-6)
    assert math.isclose(r.parsed_only_accuracy, 0.7, abs_tol=1e-6)
    twice = {tuple(x)[:4]: x for x in metrics.guard_metrics(spark.createDataFrame(rows, PRED), twin_keys=True).collect()}
    assert twice["b", "en", "P", "ALL"].examples == 22 and twice["b", "en", "P", "ALL"].accuracy == r.accuracy
    one_class = metrics.guard_metrics(spark.createDataFrame([("b", None, "P", "s", "safe", "safe", "safe")], PRED)).where("view = 'P' and subset = 's'").first()
    assert one_class.language == "None" and one_class.macro_f1 is None and one_class.unsafe_f1 == 0 and one_class.accuracy == 1
    assert metrics.guard_metrics(spark.createDataFrame([], PRED)).count() == 0


def test_levels_agree(spark):
    rows = [("b", "lang"[i % 4], "PR"[: 1 + i % 2], f"s{i % 3}", "unsafe" if i % 2 else "safe", "safe", "safe") for i in range(50)]
    got = metrics.guard_metrics(spark.createDataFrame(rows, PRED)).collect()
    for depth in range(4):
        part = [r for r in got if sum(r[k] != "ALL" for k in ("language", "view", "subset")) == depth]
        assert sum(r.examples for r in part) == 50 and sum(r.tp + r.tn + r.fp + r.fn for r in part) == 50


def test_likelihood(spark):
    docs = spark.createDataFrame([(1, "a b a", "x"), (2, "a", "x"), (3, " ", "x"), (4, None, "x")], "id long, t string, benchmark string")
    rows = {r.id: r for r in scoring.unigram_rows(docs, "id", "t", ["benchmark"]).collect()}
    assert set(rows) == {1, 2}
    assert rows[1].tokens_scored == 2 and math.isclose(rows[1].nll_nats, math.log(4) + math.log(4 / 3))
    assert rows[2].tokens_scored == 0 and rows[2].utf8_bytes == 1 and rows[2].nll_nats == 0
    full = scoring.unigram_rows(docs, "id", "t", ["benchmark"]).withColumns({k: F.lit(None).cast("string") for k in ("language", "view", "subset")})
    top = metrics.likelihood_metrics(full).where("language = 'ALL'").first()
    assert (top.examples, top.tokens_scored, top.utf8_bytes) == (2, 2, 6)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=8), st.integers(2, 20), st.data())
def test_windows(spark, sizes, length, data):
    stride = data.draw(st.integers(1, length - 1))
    df = spark.createDataFrame(list(enumerate(sizes)), "id long, n long")
    got = {}
    for r in windows.token_windows(df, "id", F.col("n"), length, stride).collect():
        got.setdefault(r.id, []).append((r.begin, r.end, r.target, r.valid))
    for i, n in enumerate(sizes):
        want, last = [], 0
        for begin in range(0, n, stride) if n > 1 else ():
            end = min(begin + length, n)
            want.append((begin, end, end - last, end - last - (begin == 0)))
            last = end
            if end == n:
                break
        assert sorted(got.get(i, [])) == want
        assert sum(w[3] for w in want) == max(0, n - 1)


def test_window_arguments():
    for length, stride in ((1, 1), (4, 4), (4, 0)):
        with pytest.raises(ValueError, match="window"):
            windows.check_window(length, stride)


def test_ranks(spark):
    models = spark.createDataFrame([(m, i, m) for i, m in enumerate("abcd")], "model string, ordinal int, run_directory string")
    ll = spark.createDataFrame([("a", 1.0, 1.0, 1), ("b", 1.0, 1.0, 1), ("c", 0.5, 1.0, 1)], "model string, bits_per_byte double, perplexity double, tokens_scored long")
    guard = spark.createDataFrame([("a", 0.5, None, 0.1, 1.0), ("b", 0.5, 0.2, 0.1, 1.0), ("d", None, 0.2, 0.1, 1.0)], "model string, macro_f1 double, unsafe_recall double, unsafe_f1 double, parse_rate double")
    got = {r.model: (r.bpb_rank, r.guard_rank, r.likelihood_ready, r.guard_ready) for r in ranking.compare_models(models, ll, guard).collect()}
    assert got == {"a": (2, 2, True, True), "b": (3, 1, True, True), "c": (1, None, True, False), "d": (None, None, False, True)}


def test_scorer(spark):
    from pyspark.sql import types as T

    seen = spark.range(10).coalesce(1)
    out = scoring.score(seen, lambda frames: (f.assign(size=len(f)) for f in frames), T.StructType([T.StructField("size", T.LongType())]), batch_rows=4)
    assert sorted(r["size"] for r in out.collect()) == [2, 2] + [4] * 8


def test_stored_tables(spark, tmp_path):
    from lexwarden import session as S

    df = spark.createDataFrame([(1, "a", 0), (2, "b", 1)], "id long, v string, part int")
    back, place = S.stored(df, by="part")
    assert sorted(tuple(r) for r in back.select("id", "v", "part").collect()) == [(1, "a", 0), (2, "b", 1)] and "://" in place
    assert S.cut(df).count() == 2 and S.shared_folder(spark).startswith("file://")
