import random
import re

import pytest

from lexwarden.llm import leakage
from lexwarden.llm.leakage import LeakIndex, leaked_items

ITEM = "How could our neighbour Salomhoel get the chat archive away from Bretesmu in plain sight? According to file 62770, Kotal rewrote a locked toolbox at the evening market. Nobody asked Dorkylem why."
OTHER = "図書館員ナケが嵐のあとで古い暗証番号の一覧を撮影したと気づいた。露店の店主ミロは缶詰工場の裏で防犯映像に72851枚の硬貨を出したがケベは断った。"
ITEMS = [(1, ITEM), (2, OTHER), (3, None), (4, ""), (5, ITEM.upper()), (6, "?!")]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        (f"Notes.\n{ITEM}\nEnd.", {1, 5}), (ITEM.upper().replace(" ", "\n> "), {1, 5}), ('{"q": "' + ITEM.replace("archive", "<b>archive</b>") + '"}', {1, 5}), (ITEM[: len(ITEM) * 6 // 10], {1, 5}),
        (ITEM.replace("chat", "mail").replace("evening", "morning"), {1, 5}), (f"cf. «{ITEM[20:60]}»", set()), ("see item 1", set()), ("", set()), (OTHER.replace("。", " "), {2}), (OTHER[:20], set()), ("x" * 200_000, set()),
        (ITEM + OTHER, {1, 2, 5}),
    ],
)
def test_search(text, found):
    assert {hit[0] for hit in LeakIndex(ITEMS).search(text)} == found


def test_place():
    text = f"Überschrift. {ITEM} Schluß"
    (_, share, low, high), *_ = LeakIndex([(1, ITEM)]).search(text)
    assert share == 1.0 and text[low:high] == ITEM[:-1]


def test_set_phrases_are_no_leak():
    rng = random.Random(7)
    styles = ["Nobody asked {n} why the courier {n} copied the ballot sheets.", "In group {d} people claim {n} sold the rent contract before dawn.", "According to file {d}, {n} hid the school roster near the tram depot.", "“the camera footage” is what {n} calls it, during the audit, at the evening market.", "The ferry crew offered {d} coins for a locked toolbox by the school fence – {n} refused.", "{n} noticed that an intern {n} leaked a forged permit for the third time."]

    def text():
        return " ".join(re.sub(r"\{(.)\}", lambda m: str(rng.randrange(10_000, 99_999)) if m[1] == "d" else "".join(rng.choices(["tal", "mu", "ko", "ri", "bre", "sal", "wo", "ven", "ji", "pra"], k=4)).title(), s) for s in rng.sample(styles, 5))

    items = [(i, text()) for i in range(60)]
    index = LeakIndex(items)
    for _ in range(40):
        assert not index.search(text())
    for i, item in items:
        assert [h[0] for h in index.search(f"x {item}")] == [i]


@pytest.mark.parametrize("n", [1, 8, 9, 12, 40])
def test_items_that_share_their_wording(n):
    """A document that holds the half that all items share holds every one of them, however many there are."""
    rng = random.Random(n)

    def words(k):
        return " ".join("".join(rng.choices("abcdefghijklmnopqrst", k=rng.randrange(3, 9))) for _ in range(k))

    shared = words(24)
    items = [(i, f"{shared} {words(15)}") for i in range(n)]
    assert {h[0] for h in LeakIndex(items).search(f"{words(30)}\n{shared}\n{words(30)}")} == set(range(n))


def test_one_phrase_changed_for_a_longer_one():
    item = "Why would Shishi say that my landlord Shijipra sold the ballot sheets under the old viaduct? In plain sight, the courier Jinu met Fiho under the old viaduct and leaked an old password list. The moderator copied it by the school fence in plain sight. A substitute teacher met Fisaljiba by the school fence and leaked the visitor ledger in plain sight."
    for old, new in (("by the school fence in plain sight", "by the school fence after the storm"), ("the ballot sheets", "the café’s till roll and more"), ("In plain sight, ", "")):
        (hit,) = LeakIndex([(7, item)]).search(f"x.\n{item.replace(old, new)}\ny.")
        assert hit[0] == 7 and hit[1] > 0.9


@pytest.mark.parametrize(("text", "found"), [("say no.", {1}), ("nothing, snow", set()), ("NO!", {1}), ("禁止です", {2})])
def test_tiny_items(text, found):
    assert {h[0] for h in LeakIndex([(1, "No"), (2, "禁止")]).search(text)} == found


def test_operator(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"a {ITEM}", "x"), (2, None, "y"), (3, "", "z"), (4, OTHER, "x"), (1, f"a {ITEM}", "x")], "doc_id long, text string, item_text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    whole = sorted(tuple(r)[:2] for r in leaked_items(docs, "doc_id", "text", items).collect())
    assert whole == [(1, 1), (1, 1), (1, 5), (1, 5), (4, 2)]
    monkeypatch.setattr(leakage, "MAX_CHARS", 100)  # several automata
    monkeypatch.setattr(leakage, "BUFFER_CHARS", 10)
    assert sorted(tuple(r)[:2] for r in leaked_items(docs, "doc_id", "text", items).collect()) == whole
    assert leaked_items(docs, "doc_id", "text", items.limit(0)).count() == 0
    assert leaked_items(docs.limit(0), "doc_id", "text", items).count() == 0
