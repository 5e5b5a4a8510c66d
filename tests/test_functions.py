import json

import pytest
from pyspark.sql import functions as F

from lexwarden.functions import parsing as P
from lexwarden.functions import text as X


def one(spark, value, *columns, schema="c string"):
    row = spark.createDataFrame([value if isinstance(value, tuple) else (value,)], schema).select(*columns).first()
    return row[0] if len(columns) == 1 else tuple(row)


@pytest.mark.parametrize(
    ("text", "prompt", "response"),
    [("Prompt: a\nResponse: b", "a", "b"), ("Prompt: a", "a", None), ("Prompt: a\nResponse:", "a", ""), ("a\nResponse:  b\nResponse: c", "a", "b\nResponse: c"), ("Prompt: 　a", "a", None)],
)
def test_split_text(spark, text, prompt, response):
    assert one(spark, text, *X.split_text(F.col("c"))) == (prompt, response)


def test_labels_and_ids(spark):
    assert one(spark, " Safe", X.lower_label(F.col("c"))) == " safe"
    assert one(spark, " An  toàn ", X.sea_label(F.col("c"))) == "safe"
    with pytest.raises(Exception, match="unsupported label"):
        one(spark, "unsafe", X.sea_label(F.col("c")))
    assert one(spark, "", X.source_id(F.col("c"), F.lit("p"), F.lit(3))) == one(spark, "p:3", X.digest(F.col("c")))
    assert one(spark, "x", X.source_id(F.col("c"), F.lit("p"), F.lit(3))) == "x"
    assert one(spark, (12345,), X.padded_line(F.col("c")), schema="c long") == "12345"
    assert one(spark, (7,), X.padded_line(F.col("c")), schema="c long") == "0007"
    assert one(spark, "", X.alias_language(F.col("c"), F.lit("in/zh_CN/a.jsonl"))) == "zh"
    assert one(spark, "file:/r/a/b.jsonl", X.relative_path(F.col("c"), "/r")) == "a/b.jsonl"
    assert one(spark, (float("nan"),), X.clean_nan(F.col("c")), schema="c double") is None
    assert one(spark, None, X.is_unsafe(F.col("c"))) == 0
    assert one(spark, "é", X.utf8_bytes(F.col("c"))) == 2
    assert one(spark, "a , ,b,", F.array_join(X.naive_categories(F.col("c")), "|")) == "a|b"


def test_head_tail(spark):
    def cut(n, budget):
        return one(spark, (list(range(n)),), X.head_tail(F.col("c"), budget), schema="c array<int>")

    assert cut(10, 5) == [0, 1, 7, 8, 9]
    assert cut(5, 5) == [0, 1, 2, 3, 4]
    assert cut(4, 1) == [3]
    assert cut(3, 0) == [0, 1, 2]
    assert one(spark, ([1, 2],), X.completion_labels(F.col("c"), F.array(F.lit(9))), schema="c array<int>") == [-100, -100, 9]


def test_targets(spark):
    row = ("PR", "unsafe", "safe", ["Malware", "Violence", "Nonsense"])
    got = one(spark, row, X.target_json(*map(F.col, ("v", "l", "p", "c"))), schema="v string, l string, p string, c array<string>")
    assert got == json.dumps({"User Safety": "safe", "Response Safety": "unsafe", "Safety Categories": "Violence, Malware"})
    assert one(spark, None, X.taxonomy_text()).startswith("S1: Violence.\nS2: Sexual.")


@pytest.mark.parametrize(
    ("text", "known", "unknown"),
    [
        ("S1, S3", ["Violence", "Criminal Planning/Confessions"], []), ("S100, S24: Violence, S1", ["Harassment", "Violence"], ["S24: Violence"]), ("S01", [], ["S01"]),
        ("Violence; Malware, Nonsense\nNonsense", ["Violence", "Malware"], ["Nonsense", "Nonsense"]), (" . violence. ", ["Violence"], []), ("S1: Malware", ["Violence"], []), ("тест", [], ["тест"]), (None, [], []),
    ],
)
def test_categories(spark, text, known, unknown):
    found = P.category_candidates(F.col("c"))
    assert one(spark, text, P.known_categories(found), P.unknown_categories(found)) == (known, unknown)


@pytest.mark.parametrize(
    ("raw", "view", "prediction", "status"),
    [
        ('{"User Safety": "safe"}', "P", "safe", "strict_json"), ('```json\n{"User Safety": "UNSAFE"}\n```', "P", "unsafe", "strict_json"), ('{"User Safety": safe}', "P", "safe", "repaired_json"),
        ('So: {"Response Safety": "safe"} ok', "PR", "safe", "repaired_json"), ('{"User Safety": " safe"}', "P", None, "PARSE_ERROR"), ("none", "P", None, "PARSE_ERROR"), (None, "P", None, "PARSE_ERROR"),
        ('{"User Safety": "safe", "User Safety": "unsafe"}', "P", "unsafe", "strict_json"), ('{"a":1} }', "P", None, "PARSE_ERROR"), ("[1]", "P", None, "PARSE_ERROR"), ('{"User Safety": "safe"}', "PR", None, "PARSE_ERROR"),
    ],
)
def test_replies(spark, raw, view, prediction, status):
    got = one(spark, (raw, view), P.parse_output(F.col("r"), F.col("v")), schema="r string, v string")
    assert (got["prediction"], got["parse_status"]) == (prediction, status)


def test_categories_survive_a_bad_label(spark):
    got = one(spark, ('{"User Safety": "maybe", "Safety Categories": ["S1", "x"]}', "P"), P.parse_output(F.col("r"), F.col("v")), schema="r string, v string")
    assert got["categories"] == ["Violence"] and got["unknown_categories"] == ["x"] and got["prediction"] is None


@pytest.mark.parametrize(
    ("raw", "status", "known"),
    [
        ('{"User Safety": "safe", "n": NaN, "Safety Categories": "S1;S2"}', "strict_json", ["Violence", "Sexual"]), ('```{"User Safety": Unsafe }```', "repaired_json", []), ('{"User Safety": "safe", "User Safety": unsafe}', "repaired_json", []),
        ('{"User Safety": "safe", "Safety Categories": null}', "strict_json", []), ('{"User Safety": "safe", "Safety Categories": []}', "strict_json", []), ('{"User Safety": true}', "PARSE_ERROR", []), ('{"User Safety": "safe"', "PARSE_ERROR", []),
        ('}{', "PARSE_ERROR", []), ('\u3000{"User Safety": "safe"}\u3000', "strict_json", []),
    ],
)
def test_reply_corners(spark, raw, status, known):
    got = one(spark, (raw, "P"), P.parse_output(F.col("r"), F.col("v")), schema="r string, v string")
    assert (got["parse_status"], got["categories"]) == (status, known)


def test_policies(spark):
    rows = spark.createDataFrame([("safe", "unsafe"), (None, "unsafe"), (None, "safe"), (None, None)], "p string, g string")
    got = {p: [r[0] for r in rows.select(P.apply_policy(F.col("p"), F.col("g"), p)).collect()] for p in P.POLICIES}
    assert got == {"incorrect": ["safe", "safe", "unsafe", "unsafe"], "unsafe": ["safe", "unsafe", "unsafe", "unsafe"], "exclude": ["safe", None, None, None]}
    with pytest.raises(ValueError, match="policy"):
        P.apply_policy(F.col("p"), F.col("g"), "other")


def test_binary(spark):
    assert one(spark, "x\n safety : Controversial \n", P.parse_binary(F.col("c"))) == "unsafe"
    assert one(spark, "Safety: safely", P.parse_binary(F.col("c"))) is None
