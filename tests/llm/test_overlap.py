import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexwarden.llm import overlap as O
from lexwarden.llm.wording import bare, bare_offsets, marked


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12), st.integers(0, 6))
def test_distance(a, b, limit):
    assert O.edit_distance_within(a, b, limit) == (distance(a, b) <= limit)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=40), st.text("ab", max_size=40)), max_size=8))
def test_many_distances(pairs):
    a, b = [p[0] for p in pairs], [p[1] for p in pairs]
    assert O.near_same_many(a, b).tolist() == [distance(x, y) <= max(len(x), len(y)) // 8 for x, y in pairs]


def test_long_distances():
    rng = random.Random(2)
    text = "".join(rng.choice("abcdef") for _ in range(2600))
    others = [scattered(rng, text, "abcdef", n) for n in (10, 300, 420)] + [text[:1900], text[200:]]
    a, b = [text] * len(others) + [text[:1500]] * 2, [*others, scattered(rng, text[:1500], "abcdef", 150), scattered(rng, text[:1500], "abcdef", 260)]
    assert O.near_same_many(a, b).tolist() == [O.near_same(x, y) for x, y in zip(a, b)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abé世", min_size=1, max_size=15), min_size=1, max_size=6), st.lists(st.text("abéx世", max_size=12), min_size=1, max_size=4), st.integers(1, 3))
def test_index_matches(texts, queries, least):
    index = O.TextIndex(texts)
    for query, found in zip(queries, index.matches(queries, least), strict=True):
        at = len(query)
        want = []
        while at > 0:  # greedy factors from the end
            low = at
            while low > 0 and any(query[low - 1 : at] in t for t in texts):
                low -= 1
            if at - low >= least:
                want.append((low, at))
            at = at - 1 if low == at else low
        assert [(a, b) for a, b, _, _ in found] == want
        for a, b, low, high in found:
            piece = query[a:b]
            where = index.text_of(np.arange(low, high))
            assert sorted(where) == sorted(i for i, t in enumerate(texts) for k in range(len(t)) if t.startswith(piece, k))


def test_near_same_pairs_against_brute_force(spark, sf_dir):
    rows = pq.read_table(f"{sf_dir.replace('0.001', '0.01')}/canonical_examples.parquet", columns=["row_id", "source_split", "prompt"]).to_pylist()
    forms = [(r["row_id"], r["source_split"] != "train", marked(r["prompt"])) for r in rows]
    grams = {}
    for key, held, text in forms:
        if held:
            for i in range(0, len(text) - 7):
                grams.setdefault(text[i : i + 8], set()).add((key, text))
    want = set()
    for key, held, text in forms:
        if not held:
            # Whoever differs in an eighth at most shares a stretch of eight characters, if the text has 80.
            for other, plain in set().union(*[grams.get(text[i : i + 8], set()) for i in range(len(text) - 7)]):
                if abs(len(text) - len(plain)) * 8 <= max(len(text), len(plain)) and O.near_same(text, plain):
                    want.add((min(key, other), max(key, other)))
    df = spark.createDataFrame([(r["row_id"], r["source_split"], "d", r["prompt"]) for r in rows], "row_id long, source_split string, dataset_source string, prompt string")
    held = F.col("source_split") != "train"
    named, distinct = O.normal_texts(df, "prompt", held, [F.col("row_id"), F.col("source_split"), F.col("dataset_source")])
    links = O.linked_forms(distinct)
    got = {tuple(r) for r in O.row_pairs(named, links, "row_id").collect()}
    assert got == want and want
    report = O.overlap_report(named, links, ["source_split", "dataset_source"])
    assert report.agg(F.sum("n_pairs")).first()[0] == len(got)


def test_index_is_whole_after_storing():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcd世") for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    index = O.TextIndex(texts)
    other = O.TextIndex.from_parts(index.parts())
    assert (index.psi == other.psi).all() and (index.starts == other.starts).all()
    joined = "\x00".join([*texts, ""])
    assert sorted(other.locate(np.arange(other.size)).tolist()) == list(range(len(joined)))
    suffixes = [joined[i:] for i in other.locate(np.arange(other.size)).tolist()]
    assert suffixes == sorted(suffixes)


SCRIPTS = ("abcdefghijklmnopqrstuvwxyz", "なにぬねのはひふへほ記録監査期間地域", "абвгдежзиклмн", "ءبتثجحخدذر", "กขคงจชซญฐณ", "कखगघचछजझटठ")


@pytest.mark.parametrize("size", [8, 12, 16, 24, 32, 64, 128, 256])
@pytest.mark.parametrize("letters", SCRIPTS)
def test_recall_at_the_tolerance(size, letters):
    """All pairs at one of eight characters are found, by pieces and by gram sets alike."""
    rng = random.Random(f"{size}{letters}")
    held = sorted({"".join(rng.choice(letters) for _ in range(size)) for _ in range(60)}, key=len)
    train = [scattered(rng, t, letters, size // 8 - (size % 8 == 0 and size > 8)) for t in held] + ["".join(rng.choice(letters) if i % 8 == 4 else c for i, c in enumerate(t)) for t in held]
    want = {(i, j) for i, a in enumerate(train) for j, b in enumerate(held) if O.near_same(a, b)}
    shard = O.Shard([b""] * len(held), held)
    assert set(shard.near(train)) == want and len(want) >= 60
    for cost in (0, 10**9):
        O.PLACE_COST, before = cost, O.PLACE_COST
        try:
            assert set(shard.near(train)) == want
        finally:
            O.PLACE_COST = before


def test_common_wording_and_tiny_texts():
    """Texts put together from the same phrases, and texts of one to nine characters, against brute force."""
    rng = random.Random(5)
    phrases = ["".join(rng.choice("abcdefgh") for _ in range(14)) for _ in range(6)]
    held = ["".join(rng.choice(phrases) for _ in range(5)) + rng.choice("xyz") for _ in range(80)]
    train = ["".join(rng.choice(phrases) for _ in range(5)) for _ in range(80)]
    tiny = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 10))) for _ in range(80)]
    held, train = sorted({*held, *tiny[:40]}, key=len), sorted({*train, *tiny[40:]})
    want = {(i, j) for i, a in enumerate(train) for j, b in enumerate(held) if O.near_same(a, b)}
    assert set(O.Shard([b""] * len(held), held).near(train)) == want


def test_plans():
    cells = [(0, 10, 50), (0, 11, 50), (0, 12, 500), (0, 40, 5), (6, 10, 5)]
    shards = O.plan_shards(cells, 100)
    assert [(p.band, p.first, p.parts) for p in shards] == [(10, 0, 1), (11, 0, 1), (12, 1, 5), (40, 6, 1), (10, 7, 1)]
    tasks, n = O.plan_tasks([(0, 11, 100), (0, 90, 10), (6, 10, 10)], shards, 4)
    assert {(p.script, p.band) for p in tasks} == {(0, 11), (6, 10)} and n >= 4
    assert all(p.first + p.parts <= n for p in tasks)


def scattered(rng, text, letters, limit):
    """The text with ``limit`` single characters changed, put in or left out, all over it, so that it stays near-same."""
    out = list(text)
    for n, at in enumerate(sorted(rng.sample(range(len(text)), limit), reverse=True)):
        out[at : at + 1] = ([rng.choice(letters)], [out[at], rng.choice(letters)], [])[n % 3]
    return "".join(out)


def test_no_near_same_pair_is_lost_up_to_an_eighth(spark):
    rng, rows = random.Random(8), []
    for n in range(240):
        letters = ("abcdefghijklmnopqrstuvwxyz", "なにぬねのはひふへほ記録監査期間地域", "абвгдежзиклмн", "abcdefgなにぬねのはひ")[n % 4]
        size = rng.choice((8, 16, 40, 76, 240, 400))
        text = "".join(rng.choice(letters) for _ in range(size))
        near = scattered(rng, text, letters, (size - size // 24) // (8, 16, 12)[n % 3]) if n % 5 else "".join(rng.choice(letters) if i % 8 == 4 else c for i, c in enumerate(text))
        rows += [(2 * n, 1, 0, text), (2 * n + 1, 0, 1, near)]
    train, held = [r for r in rows if r[1]], [r for r in rows if r[2]]
    want = {(a[0], b[0]) for a in train for b in held if a[3] != b[3] and O.near_same(a[3], b[3])}
    df = spark.createDataFrame([(i, bool(h), plain) for i, t, h, plain in rows], "n long, held boolean, plain string")
    named, forms = O.normal_texts(df, "plain", F.col("held"), [F.col("n")])
    number = {bytes(r["text_id"]): r["n"] for r in named.collect()}
    got = {(number[bytes(r[0])], number[bytes(r[1])]) for r in O.near_pairs(forms).select("train_id", "held_id").collect()}
    assert got == want and len(want) >= 200


def test_forms_and_dirt(spark):
    text = "Hello, WORLD! The courier sealed a crate of solvents in a rented garage; according to file 9755, Eltes translated an old password list."
    rows = [(1, "train", text), (2, "test", text.lower().replace(",", "")), (3, "test", None), (4, "train", "!!!"), (5, "test", "???"), (6, "valid", text.replace("9755", "6124") + " (2)"), (7, None, text), (8, "test", text[:60]), (1, "train", text)]
    df = spark.createDataFrame(rows, "row_id long, source_split string, prompt string").withColumns({"text_id": F.lit(1), "band": F.lit(2)})
    held = F.when(F.col("source_split") == "train", False).when(F.col("source_split").isNotNull(), True)
    named, forms = O.normal_texts(df, "prompt", held, [F.col("row_id")])
    assert {tuple(r) for r in O.row_pairs(named, O.linked_forms(forms), "row_id").distinct().collect()} == {(1, 2), (1, 6)}
    named, forms = O.normal_texts(df.where("source_split = 'train'"), "prompt", held, [F.col("row_id")])
    assert O.linked_forms(forms).count() == 0


def test_wording():
    assert marked("Ｃafé́ ’A’") == marked("café́ a")
    text = "x <b>É</b> ﬁ"
    assert bare(text) == "xefi"
    assert [text[i] for i in bare_offsets(text)] == ["x", "É", "ﬁ", "ﬁ"]


def test_common_wording_is_not_compared_text_by_text(monkeypatch):
    """Texts of the same phrases share pieces with all others; only those with enough of them in place are compared."""
    rng, compared = random.Random(11), []
    phrases = ["".join(rng.choice("abcdefghijklmnop") for _ in range(16)) for _ in range(40)]
    held, train = (sorted({"".join(rng.choice(phrases) for _ in range(rng.randrange(13, 16))) for _ in range(1200)}, key=len) for _ in range(2))
    train += [scattered(rng, t, "abcdefghijklmnop", len(t) // 9) for t in held[::40]]
    several = O.near_same_many
    monkeypatch.setattr(O, "near_same_many", lambda a, b: compared.append(len(a)) or several(a, b))
    shard = O.Shard([b""] * len(held), held)
    found = set(shard.near(train))
    assert {(1200 + n, 40 * n) for n in range(30)} <= found and all(O.near_same(train[i], held[j]) for i, j in found)
    assert "columns" not in vars(shard)  # the gram sets of all texts of fit length
    assert sum(compared) < 1000
    assert shard.near(["a" * 230] * 3) == []


def test_places_are_counted_only_while_cheaper():
    """Texts of one character repeated stand in every stretch, and go by gram sets."""
    held = sorted(["a" * n for n in range(60, 400, 2)] + ["ab" * n for n in range(30, 200)], key=len)
    train = ["a" * n for n in range(61, 400, 17)] + ["ab" * 60 + "b" * n for n in (3, 40)]
    want = {(i, j) for i, a in enumerate(train) for j, b in enumerate(held) if O.near_same(a, b)}
    shard = O.Shard([b""] * len(held), held)
    assert set(shard.near(train)) == want and "columns" in vars(shard)


def test_edits_at_one_end():
    """Characters put in or left out before, amid or behind everything else move the pieces farthest."""
    rng, letters = random.Random(12), "abcdefghijklmnopqrstuvwxyz"
    held = sorted({"".join(rng.choice(letters) for _ in range(n)) for n in range(7, 300, 3)}, key=len)
    train = []
    for t in held:
        n = len(t) // 8
        more = "".join(rng.choice(letters) for _ in range(len(t) // 7))
        train += [t[n:], t[: len(t) - n], more + t, t + more, t[n // 2 :] + more[: n - n // 2], more[: n // 2] + t[: len(t) - (n - n // 2)], t[: len(t) // 2] + more + t[len(t) // 2 :]]
    want = {(i, j) for i, a in enumerate(train) for j, b in enumerate(held) if O.near_same(a, b)}
    assert set(O.Shard([b""] * len(held), held).near(train)) == want and len(want) >= 5 * len(held)


def test_tasks_do_not_shrink_with_more_shards():
    """Every task reads its shards anew, so that ten times the texts on both sides make ten times the tasks, not a hundred times."""
    counts = []
    for times in (1, 10):
        shards = O.plan_shards([(0, 170, 200 * times)], 100)
        counts.append(O.plan_tasks([(0, 170, 10_000 * times)], shards, 4, 1000)[1])
    assert counts == [10, 100]
