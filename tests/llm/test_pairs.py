import pytest

from lexwarden.llm.pairs import asked_language, broken_pairs, defect

PROMPT = "Explain to Venshi what happens if an intern sealed a crate of solvents in a rented garage. According to file 9755, Eltes translated an old password list."
GOOD = "In group 16606 people claim Breji sold the visitor ledger on a public holiday. The librarian hid the rent contract under the old viaduct."
GERMAN = "Niemand fragte Fidor, warum unser Nachbar die Krankenakte wollte. Der Kurier prüfte die Genehmigung im Archiv am Feiertag."


@pytest.mark.parametrize("text", [None, "", " \n\t", "​", "null", "NaN", "n/a", "-", "…", "{}", "[]", '""', "<empty>", "(no response)", "Response:", "Assistant:\n", "。"])
def test_empty(text):
    assert defect(PROMPT, text) == "empty" and defect(None, text) == "empty"


@pytest.mark.parametrize(
    "text",
    [
        "I’m sorry, but I can’t help with that.", "**Hello, I’m sorry, but I can’t help with that.**", "no. i can't talk about this topic, sorry !", "Debo rechazar esta petición.", "Una duda Lo siento, no puedo ayudarte con eso.",
        "No puedo tratar ese tema, Shiho. Pregúntame otra cosa, por favor.", "这个问题我不能回答。这个问题我不能回答。", "翎岚，这类内容我不便提供，请换一个问题 !", "เรื่องนี้ตอบให้ไม่ได้ค่ะ คุณ เกโมบูเก กรุณาถามเรื่องอื่นนะคะ",
    ],
)
def test_refusal(text):
    assert defect(PROMPT, text) == "refusal"


#: Written apart from the templates, to measure and not to tune by.
DECLINED = [
    "I'd rather not get into that one.", "Sorry, that's off limits for me.", "I'm sorry, I really can't help you with this one.", "I can't answer this question, sorry.", "I'm afraid I cannot assist you with that request.",
    "Sorry, but I am not able to help with this.", "I won't be able to provide that information.", "I’m not comfortable answering this, Shiho.", "I refuse to talk about this topic.", "That would go against my guidelines, so no.",
    "Es tut mir leid, aber dabei kann ich dir nicht helfen.", "Diese Frage kann ich leider nicht beantworten.", "Darüber möchte ich lieber nicht sprechen.", "Lo siento mucho, pero no puedo ayudarte con esa petición.", "No puedo responder esta pregunta.",
    "Désolé, mais je ne peux pas vous aider avec cela.", "Je ne peux pas répondre à cette question.", "Xin lỗi, tôi không thể giúp bạn việc này.", "抱歉，我无法回答这个问题。", "对不起，我不能提供这些信息。", "申し訳ありませんが、その質問には答えられません。",
    "ขออภัยค่ะ ดิฉันช่วยเรื่องนี้ไม่ได้", "عذرا، لا أستطيع الإجابة عن هذا السؤال الآن.", "माफ़ कीजिए, मैं इस सवाल का जवाब नहीं दे सकता।", "I'm gonna sit this one out.", "That's a no from me, pick another subject.",
]
ANSWERED = [
    "I must decline this request. Cut off power first.", "I can't say everything about this, but here is what is known: the courier hid the roster.", "The librarian could not help with that, so the clerk did it.", "You cannot assist a patient without a licence; call the nurse.",
    "Sorry for the delay. The stamp was counterfeit.", "They refused to answer this question at the hearing.", "No puedo decirte el día exacto, pero fue antes del alba en el puerto.", "Das kann ich nicht genau sagen, aber der Kurier kam am Montag.", "我无法确认日期，不过合同是在周一签的，地点在旧高架桥下。",
    "Je ne peux pas confirmer la date, mais le coursier est passé lundi.", "According to my guidelines the form goes to the clerk.", "I am not able to find the ledger; the intern has it in the garage.",
]


def test_refusals_in_other_words():
    hit = [t for t in DECLINED if defect(PROMPT, t) == "refusal"]
    false = [t for t in ANSWERED if defect(PROMPT, t) == "refusal"]
    assert not false
    assert len(hit) >= 0.65 * len(DECLINED), sorted(set(DECLINED) - set(hit))


@pytest.mark.parametrize("text", ["- one thing is done.\n- another thing is done.\n- the third is not", "* a clerk came.\n* the old passw"])
def test_bullets_cut_after_whole_ones(text):
    assert defect(PROMPT, text) == "truncated"


@pytest.mark.parametrize("text", [PROMPT, PROMPT.upper(), f"Prompt: {PROMPT}", f"« {PROMPT} »", f"> {PROMPT}", PROMPT.replace(",", "").replace(".", ""), f"User asked:\n{PROMPT}", f"{PROMPT}\n{PROMPT}"])
def test_copy(text):
    assert defect(PROMPT, text) == "copy_prompt"


@pytest.mark.parametrize(
    "text",
    [GOOD[:-12], GOOD[:-1] + " because the", GOOD + "\n2.", "1. " + GOOD + "\n2. our neighbour,", GOOD + ' ```json\n{"User Safety": "uns', "“" + GOOD, GOOD + " My landlord (a forged permit", GOOD + " “the chat archive, in the flooded archive-", "- a courier: the roster\n- a clerk:"],
)
def test_truncated(text):
    assert defect(PROMPT, text) == "truncated"


@pytest.mark.parametrize("text", [GERMAN, "In group 5 people claim it. " + GERMAN, "没有人问版主为何举报了仿制的印章。审计期间，代课老师卖掉了许可证。"])
def test_other_language(text):
    assert defect(PROMPT, text) == "other_language"


@pytest.mark.parametrize(
    ("prompt", "text"),
    [
        (PROMPT, GOOD), (PROMPT, GOOD + " 🙂"), (PROMPT, GOOD + " (Prakyprawo, 52)"), (PROMPT, f"“{GOOD}”"), (PROMPT, GOOD + '\n```json\n{"file": 132}\n```'), (PROMPT, GOOD + "\n- a market trader: a counterfeit stamp\n- the courier: the rent contract"),
        (PROMPT, "I can’t say everything about this, but here is what is known. " + GOOD), (PROMPT, "Sorry for the late reply, here is the answer. " + GOOD), (PROMPT, f"“{GERMAN.split('. ')[0]}.”\n{GOOD} {GOOD}"), (PROMPT, f"“{PROMPT}”\n{GOOD} {GOOD}"),
        (PROMPT + " Please answer in German.", GERMAN), ("Explica a Shiky qué pasa con el libro. Responde en alemán, por favor.", GERMAN), (None, GERMAN), ("", GOOD), (GERMAN, GERMAN.replace("Fidor", "Kyfi").replace("Krankenakte", "Schülerliste") + " Laut Akte 5 war es so."),
        ("ไม่มีใครถาม ว่าทำไม", "กลุ่ม 30155 เล่าว่า ลินราน แก้ไข สมุด ค่ะ"), (PROMPT, "„den Werkzeugkasten“, so nennt es Taldor. " + GOOD + " " + GOOD),
    ],
)
def test_good_answers(prompt, text):
    assert defect(prompt, text) is None


def test_chinese_after_a_japanese_sentence():
    prompt = "隣の住人ヴィトヴィは電車の車庫の近くで他人の日記に31188枚の硬貨を出したがユロリトは断った。"
    own = "ソミテヴィは夜勤の係員モネソミが人前で来客名簿をすり替えたと気づいた。"
    chinese = "没有人问版主为何举报了仿制的印章。审计期间，代课老师在旧高架桥下卖掉了伪造的许可证。隔壁邻居在罐头厂后面翻译了上锁的工具箱。"
    assert defect(prompt, f"{own} {chinese}") == "other_language"
    assert defect(prompt, own + own) is None


def test_asked_language():
    assert asked_language("… 请用日文回答。") == {"ja"} and asked_language("He is German.") == set() and asked_language("Réponds en allemand.") == {"de"}


def test_operator(spark):
    rows = [(1, PROMPT, GOOD, "safe"), (2, PROMPT, None, "safe"), (3, PROMPT, None, None), (4, None, GOOD[:-12], "x"), (2, PROMPT, None, "safe"), (5, PROMPT, GOOD * 3000, "safe")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "raw_id long, prompt string, response string, response_label string, defect string")
    got = sorted(tuple(r) for r in broken_pairs(df, "raw_id", "prompt", "response", "response_label").collect())
    assert got == [(2, "empty"), (2, "empty"), (4, "truncated")]
    assert broken_pairs(df.limit(0), "raw_id", "prompt", "response", "response_label").count() == 0
