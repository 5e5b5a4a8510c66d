import unicodedata

import pytest

from lexwarden.llm.garble import examine, garbled_texts

TEXTS = {
    "en": "“the rent contract” is what Jisal calls it – the café’s till roll, someone’s diary.",
    "fr": "Personne n’a demandé à Testaldor pourquoi une remplaçante a photographié la liste des élèves pendant la journée.",
    "de": "Die Fährcrew prüfte die gefälschte Genehmigung für einen früheren Schüler am Straßenbahndepot, wählte später.",
    "es": "¿Cómo lograría la moderadora quitarle una caja de somníferos? Según la ficha filtró imágenes de la cámara.",
    "vi": "Nhóm kể rằng Talfi đã niêm phong con dấu giả không báo trước. Không ai hỏi tại sao đã sửa sổ khách.",
    "ar": "لاحظ جادو أن متدرب جديد بدّل تصريحا مزورا أثناء التدقيق. لم يسأل أحد لماذا باع صندوق المذيبات.",
    "hi": "किसी ने नहीं पूछा कि डाकिया मतपत्र क्यों जाँचता है। समूह में कहते हैं कि वह सील करता है।",
    "th": "ไม่มีใครถาม ว่าทำไม เพื่อนบ้าน ขาย แฟ้มคนไข้ ค่ะ หลังพายุ แม่ค้าตลาด พบ สมุด",
    "ja": "なぜ配達員が鍵付きの工具箱を売ったのかホソベに聞く人はいない。診療記録を書き換えたと気づいた。",
    "zh": "没有人问版主为何举报了仿制的印章。审计期间，代课老师在旧高架桥下卖掉了伪造的许可证。",
}
PAIRS = [(code, "utf-8", page) for code in TEXTS for page in ("latin-1", "mac_roman", "cp437", "cp850")] + [
    (code, "utf-8", "cp1252") for code in ("en", "fr", "de", "es", "vi", "hi", "th", "zh")
] + [("ar", "cp1256", "cp1252"), ("th", "cp874", "latin-1"), ("zh", "gbk", "latin-1"), ("ja", "euc_jp", "latin-1"), ("fr", "utf-8", "cp1251"), ("en", "utf-8", "cp1251"), ("vi", "utf-8", "cp1251")]


def misread(text, real, page):
    out = []
    for byte in text.encode(real):
        out.append(bytes([byte]).decode(page, "ignore") or chr(byte))
    return "".join(out)


@pytest.mark.parametrize(("code", "real", "page"), PAIRS)
def test_found_and_restored(code, real, page):
    text = TEXTS[code]
    found = examine(misread(text, real, page))
    assert found is not None
    assert found[1] == text


@pytest.mark.parametrize(("code", "page"), [(c, p) for c in ("zh", "ja") for p in ("gb18030", "cp932", "big5", "euc_kr")] + [("fr", "gb18030"), ("de", "gb18030"), ("ar", "gb18030"), ("hi", "gb18030"), ("th", "gb18030")])
def test_double_byte_pages_found(code, page):
    assert examine(TEXTS[code].encode().decode(page, "replace")) is not None


@pytest.mark.parametrize("code", ["fr", "de", "es"])
def test_lost_text_is_found_without_restoring(code):
    assert examine(TEXTS[code].encode("latin-1", "replace").decode("utf-8", "replace"))[1] is None


def test_twice():
    text = TEXTS["de"]
    assert examine(misread(misread(text, "utf-8", "cp1252"), "utf-8", "cp1252"))[1] == text


def test_only_garbled_spans_change():
    text = TEXTS["ja"] + "\nDas Mädchen heißt Zoë; naïve Ängste.\n" + misread(TEXTS["fr"], "utf-8", "cp1252") + "\n" + TEXTS["ar"]
    assert examine(text)[1] == TEXTS["ja"] + "\nDas Mädchen heißt Zoë; naïve Ängste.\n" + TEXTS["fr"] + "\n" + TEXTS["ar"]


@pytest.mark.parametrize(
    "text",
    [
        *TEXTS.values(), *[t.upper() for t in TEXTS.values()], *[unicodedata.normalize("NFD", t) for t in TEXTS.values()], *[f"{a} {b}" for a, b in zip(TEXTS.values(), reversed(TEXTS.values()))],
        None, "", " ", "plain", "38 °C, ± 3 %, ½ €, № 58 ©", "ÂNCORA, SÃO, MAÇÃ, ÎLE, À PÂQUES", "q=%C3%A9t%C3%A9&x=\\u00e9 &eacute; &#233;", "👍🏽 🙂 a​b", "ａｂｃ １２３", "Привет, как дела? дії різні", "┌──┐ │é│ └──┘", "Ωμέγα",
        "«À», “É” – Œuvre…", "ﾊﾝｶｸ ｶﾅ", "x" * 100_000,
    ],
)
def test_right_text_is_left_alone(text):
    assert examine(text) is None


@pytest.mark.parametrize(("code", "real", "page"), [("ja", "euc_jp", "cp1252"), ("ja", "cp932", "cp1252"), ("zh", "gbk", "cp1252"), ("ar", "cp1256", "cp1252"), ("ar", "cp1256", "mac_roman"), ("th", "cp874", "cp1252")])
@pytest.mark.parametrize("other", ["ja", "zh", "ar", "th", "de"])
def test_legacy_span_beside_right_text_on_the_line(code, real, page, other):
    right = f"{TEXTS[other]} Das Mädchen heißt Zoë; naïve Ängste. "
    for before, after in ((right, ""), ("", " " + right), (TEXTS[other], TEXTS["ja"])):
        assert examine(before + misread(TEXTS[code], real, page) + after)[1] == before + TEXTS[code] + after


RIGHT = ["Zoé 한국 😀: ", "Grüße aus Köln: ", "ΑΒΓΔ café ÄÖÜÄÖÜ: ", "日本の試験 é 😀: ", "Привет é: ", "สวัสดี ß: "]


@pytest.mark.parametrize("right", RIGHT)
@pytest.mark.parametrize(("code", "page"), [("ja", "cp1252"), ("zh", "mac_roman"), ("fr", "cp1252"), ("de", "latin-1"), ("vi", "cp1252"), ("th", "cp1252"), ("fr", "cp1251")])
def test_right_text_beside_a_span_stays(right, code, page):
    bad = misread(TEXTS[code], "utf-8", page)
    for before, after in ((right, " ok."), ("ok. ", " " + right), (right + "\n", "\n" + right)):
        assert examine(before + bad + after)[1] == before + TEXTS[code] + after


@pytest.mark.parametrize("right", RIGHT)
@pytest.mark.parametrize(("code", "page"), [("fr", "gb18030"), ("de", "gb18030"), ("ar", "gb18030"), ("de", "cp932"), ("es", "gb18030")])
def test_right_text_beside_a_double_byte_span_stays(right, code, page):
    bad = TEXTS[code].encode().decode(page, "replace")
    assert bad.encode(page, "replace").decode("utf-8", "replace") == TEXTS[code]
    for before, after in ((right, " ok."), (right + "\n", "\n" + right)):
        assert examine(before + bad + after)[1] == before + TEXTS[code] + after


@pytest.mark.parametrize("right", RIGHT)
def test_right_mixed_text_is_left_alone(right):
    for text in (right, right * 2, right + TEXTS["fr"], right + TEXTS["ja"], right + TEXTS["zh"], right + TEXTS["ar"], right + TEXTS["de"].upper()):
        assert examine(text) is None


@pytest.mark.parametrize(
    ("text", "restored"),
    [
        ("#59340 @¥æ¥Ê wrote:\n書類15606によると", "#59340 @ユナ wrote:\n書類15606によると"), ("incident 繝阪ユ繝｢\n監査の間に", "incident ネト模"), ("incident 鐝傜弬\n没有人问珂珂璟为何", "incident 珂珂\n没有人问珂珂璟为何"),
        ("\x81\u02dc 59 Sexual (128)\n掲示板", "§ 59 Sexual (128)\n掲示板"), ("¡ø 52 Manipulation\n夜勤の", None), ("SegГєn la ficha 28860", "Según la ficha 28860"), ("搂 43 Immoral (220)\n\nNadie", "§ 43 Immoral (220)\n\nNadie"),
        ("don\x92t", "don’t"), ("a \x81 b", None),
    ],
)
def test_short_finds(text, restored):
    found = examine(text)
    assert found is not None
    if restored and "模" not in restored:
        assert found[1] == restored


@pytest.mark.parametrize("page", ["cp1252", "latin-1", "mac_roman", "gb18030"])
def test_share_restored_over_a_table(page):
    """Known texts, garbled in a middle stretch: most come back as they were, and none comes back as something else."""
    texts = [f"{a} {b} {c}" for a in TEXTS.values() for b in TEXTS.values() for c in ("ok", TEXTS["en"])]
    same = wrong = lossy = 0
    for text in texts:
        at, end = len(text) // 4, 3 * len(text) // 4
        bad = misread(text[at:end], "utf-8", page) if page != "gb18030" else text[at:end].encode().decode(page, "replace")
        if "\ufffd" in bad:
            lossy += 1
            continue
        found = examine(text[:at] + bad + text[end:])
        same += found is not None and found[1] == text
        wrong += found is not None and found[1] not in (None, text)
    tested = len(texts) - lossy
    assert same >= 0.9 * tested, (same, wrong, tested)
    assert wrong <= 0.02 * tested, (same, wrong, tested)


def test_not_restored_while_garbled_runs_are_left():
    way, restored = examine(TEXTS["ja"] + misread(TEXTS["ja"], "euc_jp", "cp1252") + "ÿÿÿÿ")
    assert way == "legacy page in a Western page" and restored is None


def test_operator(spark):
    bad = misread(TEXTS["fr"], "utf-8", "cp1252")
    df = spark.createDataFrame([(1, bad, "a"), (2, None, "b"), (3, "", "c"), (4, TEXTS["fr"], "d"), (1, bad, "a"), (5, bad * 500, "e")], "doc_id long, text string, restored string")
    got = [(r.doc_id, r.restored) for r in garbled_texts(df, "doc_id", "text").collect()]
    assert sorted(k for k, _ in got) == [1, 1, 5] and all(r in (TEXTS["fr"], TEXTS["fr"] * 500) for _, r in got)
    assert garbled_texts(df.limit(0), "doc_id", "text").count() == 0
