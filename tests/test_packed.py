import ast
import csv
import io
import json
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexwarden.operators.packed import packed_multi, packed_values, split_batch

CASES = [
    (None, []), ("", []), ("  ", []), ("a", ["a"]), (" a , b ", ["a", "b"]), ("a,,b; ;c", ["a", "b", "c"]), ("a，b；c、d｜e", ["a", "b", "c", "d", "e"]),
    ("x\r\ny\r\n", ["x", "y"]), ("a / b / ", ["a", "b"]), ("PII/Privacy", ["PII/Privacy"]), ("S1 - Violence", ["S1 - Violence"]), ("a||b||", ["a", "b"]),
    ('"Hoax, local"', ["Hoax, local"]), ('"T ""v""";N', ['T "v"', "N"]), ('["T \\"v\\"", "N"]', ['T "v"', "N"]), ("['a, b', 'c']", ["a, b", "c"]), ("['T \"v\"', 'B']", ['T "v"', "B"]),
    ("[a, b]", ["a", "b"]), ("[]", []), ('["x"]', ["x"]), ("(1) A (2) B/C (3) Sexual (minor)", ["A", "B/C", "Sexual (minor)"]), ("1. A\n2. B", ["A", "B"]), ("1) A; 2) B", ["A", "B"]),
    ("- a\n- S1 - b", ["a", "S1 - b"]), ("* a\n* b", ["a", "b"]), ("• a\n• b", ["a", "b"]), ('"open, b', ['"open', "b"]), ("Sexual (minor) 2. x", ["Sexual (minor) 2. x"]),
    ("a, a", ["a", "a"]), ("Guns and Illegal Weapons, b", ["Guns and Illegal Weapons", "b"]), ("a\tb", ["a", "b"]),
]


def split(texts):
    parent, pos, values = split_batch(pa.array(texts, pa.string()))
    out = [[] for _ in texts]
    for i, p, v in zip(parent, pos, values.to_pylist()):
        out[i].append(v)
        assert p == len(out[i])
    return out


def test_cases_together_and_alone():
    assert split([t for t, _ in CASES]) == [v for _, v in CASES]
    for text, values in CASES:
        assert split([text]) == [values]


def test_sliced_array_and_empty_batch():
    array = pa.array([t for t, _ in CASES], pa.string()).slice(3, 5)
    parent, _, values = split_batch(array)
    assert len(values) == sum(len(v) for _, v in CASES[3:8])
    assert len(split_batch(pa.array([], pa.string()))[2]) == 0
    assert len(split_batch(pa.array([None, ""], pa.string()))[2]) == 0


WORD = st.text(st.sampled_from("abcXYZéß中/ S1"), min_size=1, max_size=8).map(lambda s: re.sub(r"\s*/\s*", "/", s.strip())).filter(lambda s: s.strip("/ ") and not s.startswith("/") and not s.endswith("/"))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(WORD, min_size=1, max_size=5), min_size=1, max_size=6), st.sampled_from([", ", ";", " | ", "\n", "，", "、", "\t", " / ", " • "]))
def test_against_plain_split(rows, sep):
    assert split([sep.join(r) for r in rows]) == rows


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.text(st.sampled_from('ab,; "'), min_size=1, max_size=6).map(str.strip).filter(lambda s: s.strip('" ,;') and not s.startswith('"') and not s.endswith('"')), min_size=1, max_size=4), min_size=1, max_size=4))
def test_against_csv_and_json(rows):
    texts = []
    for r in rows:
        out = io.StringIO()
        csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="").writerow(r)
        texts.append(out.getvalue())
    assert split(texts) == rows
    assert split([json.dumps(r) for r in rows]) == rows
    assert [ast.literal_eval(json.dumps(r)) for r in rows] == rows


def test_operator(spark):
    rows = [(1, "a, b", "x"), (2, None, "y"), (None, "c", None), (1, "a, b", "x"), (3, "v" * 100_000 + ", w", "z")]
    df = spark.createDataFrame(rows, "row_key long, packed string, value string")
    out = sorted((r.row_key or 0, r.pos, r.value[:3]) for r in packed_values(df, "row_key", "packed").collect())
    assert out == [(0, 1, "c"), (1, 1, "a"), (1, 1, "a"), (1, 2, "b"), (1, 2, "b"), (3, 1, "vvv"), (3, 2, "w")]
    assert sorted({r.row_key for r in packed_multi(df, "row_key", "packed").collect()}) == [1, 3]
    assert packed_multi(df.limit(0), "row_key", "packed").count() == 0


@pytest.mark.parametrize("text", ['"', "''", ",", ";;", "[", "]", "(1)", "1.", "- ", "/ /"])
def test_odd_fields_do_not_crash(text):
    split([text, "a,b", text])
