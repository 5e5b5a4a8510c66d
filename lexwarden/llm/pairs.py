"""Broken prompt and response pairs (problem 2).

Each pair gets at most one defect, tested in this order:

* ``empty``: null, blank, or only a sign or placeholder for no answer;
* ``refusal``: sentences aligned against refusal templates, nothing of weight is left beside them;
* ``copy_prompt``: shingles of the response are contained in the prompt, and a longest common subsequence over tokens
  confirms that it is the prompt's wording and nothing else;
* ``other_language``: most of the response is in a language that neither the prompt is in nor asks for;
* ``truncated``: the response stops amid a word, sentence, list, quotation or block.

Defined results: a null response label gives no row; a null or blank prompt has no wording to copy and no language to
differ from, so only the other defects apply; repeated deliveries count each.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexwarden.llm.wording import bare
from lexwarden.session import spread

#: What stands for no answer, in the bare form.
PLACEHOLDERS = frozenset("null none nil nan na undefined empty blank noresponse noanswer noreply assistant response answer reply output todo tbd missing".split())

#: Refusal templates; answers are aligned against them, names and greetings around them are set aside.
REFUSALS = (
    # en
    "I’m sorry, but I can’t help with that.", "I'm sorry, but I cannot help with that.", "I can’t help with that.", "I won't assist with this request.", "I cannot assist with this request.",
    "I can't assist with that.", "I'm unable to help with this.", "As a guard assistant I have to decline.", "I have to decline.", "I must decline this request.",
    "Requests of this sort go against the usage policy, so no answer will be given here.", "no. I can't talk about this topic, sorry", "I can't talk about this topic",
    "That is not something I am able to support", "Please ask me about something else.", "I'm sorry, but I can't", "I cannot comply with this request.", "I will not answer this.",
    "I am not able to answer that question.", "I would rather not discuss that.", "I am not comfortable answering this.", "I am going to pass on this one.", "Sorry, that is off limits for me.", "That goes against my guidelines.",
    "I do not want to talk about this.", "I have to refuse.", "I can't provide that information.", "I can't share details about this.", "Sorry, I can't do that.", "I can't support this request.", "No comment on that from me.",
    # de
    "Es tut mir leid, dabei kann ich nicht helfen.", "Diese Anfrage muss ich ablehnen.", "Das unterstütze ich nicht", "Bitte stelle eine andere Frage.",
    "Über dieses Thema darf ich keine Auskunft geben, da es gegen die Nutzungsregeln verstößt.", "Dabei kann ich leider nicht helfen.", "Das kann ich nicht beantworten.",
    "Darüber möchte ich nicht sprechen.", "Dazu kann ich nichts sagen.", "Ich darf diese Information nicht geben.", "Das widerspricht meinen Richtlinien.", "Ich werde diese Frage nicht beantworten.",
    # es
    "Lo siento, no puedo ayudarte con eso.", "Debo rechazar esta petición.", "No puedo tratar ese tema", "Pregúntame otra cosa, por favor.",
    "Esta solicitud va contra las normas de uso, así que no daré ninguna respuesta.", "No puedo ayudar con esta solicitud.",
    "Prefiero no hablar de eso.", "No puedo responder a esa pregunta.", "No puedo dar esa información.", "Eso va contra mis normas.", "No voy a contestar a esto.",
    # fr
    "Désolé, je ne peux pas vous aider sur ce point.", "Je dois refuser cette demande.", "Ce n’est pas un sujet que je peux traiter", "Posez-moi une autre question.", "Pose-moi une autre question.",
    "Votre requête est contraire à la politique d’usage ; aucune réponse ne sera donnée.", "Cette requête est contraire à la politique d’usage ; aucune réponse ne sera donnée.", "Je ne peux pas répondre à cette demande.",
    "Je préfère ne pas en parler.", "Je ne peux pas vous donner cette information.", "Cela va à l’encontre de mes règles.", "Je refuse de répondre à cette question.", "Désolé, c’est impossible pour moi.",
    # vi
    "Xin lỗi, tôi không thể giúp việc này.", "Tôi phải từ chối yêu cầu này.", "Tôi không thể trả lời câu hỏi này.", "Tôi không muốn nói về chuyện này.", "Điều này trái với quy định sử dụng.", "Tôi không thể cung cấp thông tin này.",
    # ar
    "عذرا، لا أستطيع المساعدة في هذا.", "يجب أن أرفض هذا الطلب.", "هذا الطلب يخالف سياسة الاستخدام ولذلك لن أجيب عنه.", "لا يمكنني الحديث عن ذلك", "اسألني عن شيء آخر من فضلك.", "لا أستطيع الإجابة عن هذا السؤال.", "أفضل عدم الحديث عن هذا الموضوع.", "لا يمكنني تقديم هذه المعلومات.",
    # hi
    "माफ़ कीजिए, मैं इसमें मदद नहीं कर सकता।", "मुझे यह अनुरोध अस्वीकार करना होगा।", "यह अनुरोध उपयोग नीति के विरुद्ध है, इसलिए उत्तर नहीं दिया जाएगा।", "इस विषय पर मैं कुछ नहीं कह सकता।", "कृपया कुछ और पूछें।", "मैं इस सवाल का जवाब नहीं दे सकता।", "मैं यह जानकारी नहीं दे सकता।", "मैं इस बारे में बात नहीं करना चाहता।",
    # ja
    "申し訳ありませんが、お手伝いできません。", "このご依頼はお断りします。", "利用規約に反するため、回答は差し控えます。", "その話題にはお答えできません。", "別の質問をどうぞ。", "この質問には答えられません。", "その情報は提供できません。", "これについては話したくありません。",
    # th
    "ขออภัย ดิฉันช่วยเรื่องนี้ไม่ได้ค่ะ", "ต้องขอปฏิเสธคำขอนี้ค่ะ", "คำขอนี้ขัดกับนโยบายการใช้งาน จึงไม่ขอให้คำตอบค่ะ", "เรื่องนี้ตอบให้ไม่ได้ค่ะ", "กรุณาถามเรื่องอื่นนะคะ", "ฉันไม่สามารถตอบคำถามนี้ได้", "ไม่สามารถให้ข้อมูลนี้ได้ครับ", "ไม่อยากพูดถึงเรื่องนี้ค่ะ",
    # zh
    "抱歉，我无法协助这个请求。", "这个问题我不能回答。", "该请求不符合使用政策，因此恕不作答。", "这类内容我不便提供", "请换一个问题。", "我无法回答这个问题。", "我不能提供这些信息。", "我不想谈论这个话题。",
)

#: Function words of the Latin-script languages.
FUNCTION_WORDS = {
    "en": "the that what who is was and how why of to in a an on for with at by from this my our if when which calls according people nobody someone me it are be not",
    "de": "der die das dem den des und wer ein eine einer einem nach auf im unter in mein unser warum so nennt es ist von zu mit für am vor niemand laut heißt sagt wenn falls als ohne hinter gegen zum nicht",
    "es": "el la los las que de del un una en y por qué nuestro mi con sin para lo le se según nadie como cómo al así tras bajo junto cuando si no su a vio así qué quién esto eso pero desde hasta sobre antes ningún nuestra mis sus",
    "fr": "le la les de des du un une dans et que qui à pourquoi au aux est par sur pour notre mon ce cette selon on dit sans avec personne si contre sous le l d n a été dit après avant devant mais où ou en pas plus cela celle ceux leur nos vos je tu il elle nous vous",
    "vi": "một là và trong đã người cách tại ai của cho không các theo nhóm được tôi này khi bị vào có với trên dưới cạnh rồi",
}
_WORD_LANGUAGE: dict[str, set[str]] = {}
for _language, _words in FUNCTION_WORDS.items():
    for _word in _words.split():
        _WORD_LANGUAGE.setdefault(_word, set()).add(_language)
#: How prompts name the language they want.
LANGUAGE_NAMES = {
    "en": "english englisch inglés anglais 英語 英文 英语 ภาษาอังกฤษ الإنجليزية الانجليزية अंग्रेज़ी अंग्रेजी tiếng anh",
    "de": "german deutsch alemán allemand ドイツ語 德文 德语 ภาษาเยอรมัน الألمانية जर्मन tiếng đức",
    "es": "spanish spanisch español espagnol スペイン語 西班牙文 西班牙语 ภาษาสเปน الإسبانية स्पेनिश स्पैनिश tiếng tây ban nha",
    "fr": "french französisch francés français フランス語 法文 法语 ภาษาฝรั่งเศส الفرنسية फ़्रेंच फ्रेंच फ़्रांसीसी tiếng pháp",
    "vi": "vietnamese vietnamesisch vietnamita vietnamien ベトナム語 越南文 越南语 ภาษาเวียดนาม الفيتنامية वियतनामी tiếng việt",
    "ar": "arabic arabisch árabe arabe アラビア語 阿拉伯文 阿拉伯语 ภาษาอาหรับ العربية अरबी tiếng ả rập",
    "hi": "hindi ヒンディー語 印地文 印地语 ภาษาฮินดี الهندية हिंदी हिन्दी tiếng hindi",
    "ja": "japanese japanisch japonés japonais 日本語 日文 日语 ภาษาญี่ปุ่น اليابانية जापानी tiếng nhật",
    "th": "thai thailändisch tailandés thaï タイ語 泰文 泰语 ภาษาไทย التايلاندية थाई tiếng thái",
    "zh": "chinese chinesisch chino chinois 中国語 中文 汉语 ภาษาจีน الصينية चीनी tiếng trung",
    "ko": "korean koreanisch coreano coréen 韓国語 韩文 韩语 ภาษาเกาหลี الكورية कोरियाई tiếng hàn",
}
#: A word that asks for an answer or a translation must stand beside the name.
_ASKS = re.compile(
    r"answer|repl|respond|respon|write|translat|antwort|übersetz|schreib|contest|traduc|escrib|répond|réponse|tradui|écri|答え|訳|書い|回答|翻译|翻譯|ตอบ|แปล|เขียน|أجب|جواب|بالل|ترجم|اكتب|उत्तर|जवाब|अनुवाद|लिख|trả lời|dịch|viết",
    re.IGNORECASE,
)
_NAMES = sorted(((name, code) for code, names in LANGUAGE_NAMES.items() for name in re.split(r"\s+(?!anh|đức|tây|ban|nha|pháp|việt|ả|rập|hindi$|nhật|thái|trung|hàn)", names)), key=lambda x: -len(x[0]))
_SENTENCE = re.compile(r"(?<=[.!?。！？।؟])\s+|(?<=[。！？।])|\n+")
_WORDS = re.compile(r"[^\W\d_]+(?:’[^\W\d_]+)?")
#: Letters and marks of each script, as runs.
_SCRIPTS = tuple(
    (name, re.compile(f"[{letters}]+").findall)
    for name, letters in (
        ("latin", "A-Za-zÀ-ÖØ-öø-ɏ\u0300-\u036fḀ-ỿ"), ("ar", "ء-ۓۺ-ݿ"), ("hi", "\u0900-\u0963\u0970-\u097f"), ("th", "\u0e01-\u0e4e"),
        ("kana", "ぁ-ヿㇰ-ㇿ"), ("han", "㐀-鿿"), ("ko", "가-힣"),
    )
)
_INVISIBLE = re.compile(r"[​-‏⁠﻿­]")
_ENDS = re.compile(r"[.!?。！？।؟…”»」』’\"'）)\]】`*_~>]$|(?:ค่ะ|คะ|ครับ|นะคะ|จ้ะ)$")
_LIST_MARK = re.compile(r"^\s*(?:[-*•–]|\(?\d{1,3}[.)])\s*")
_NUMBERED_MARK = re.compile(r"^\s*\(?\d{1,3}[.)]\s*")

SHINGLE = 5


def languages(text: str) -> Counter:
    """Letters of the text by language; Latin-script sentences count by their function words."""
    out: Counter = Counter()
    for sentence in _SENTENCE.split(text):
        if not sentence:
            continue
        scripts = Counter({name: sum(map(len, find(sentence))) for name, find in _SCRIPTS})
        if scripts["kana"]:
            scripts["ja"] = scripts.pop("kana") + scripts.pop("han")
        elif scripts["han"]:
            scripts["zh"] = scripts.pop("han")
        latin = scripts.pop("latin", 0)
        out.update({k: v for k, v in scripts.items() if v})
        if latin:
            votes: Counter = Counter()
            for word in _WORDS.findall(sentence.lower()):
                known = _WORD_LANGUAGE.get(word)
                if known:
                    for language in known:
                        votes[language] += 1 / len(known)
                elif "’" in word:
                    votes["fr"] += len(word.split("’")[0]) == 1
            best = votes.most_common(2)
            if best and (len(best) == 1 or best[0][1] > best[1][1]):
                out[best[0][0]] += latin
            else:
                out["latin"] += latin
    return out


def main_language(counts: Counter) -> str | None:
    """The language of most letters, unknown Latin letters set aside."""
    known = {k: v for k, v in counts.items() if k != "latin"}
    return max(known, key=known.get) if known else None


def asked_language(prompt: str) -> set[str]:
    """Languages that the prompt asks an answer in."""
    low = prompt.lower()
    out = set()
    for sentence in _SENTENCE.split(low):
        if _ASKS.search(sentence):
            out |= {code for name, code in _NAMES if name in sentence}
    return out


def is_empty(response: str | None) -> bool:
    """Nothing, or a sign or placeholder for nothing."""
    if response is None:
        return True
    plain = bare(re.sub(r"[<>]", " ", _INVISIBLE.sub("", response)))
    return not plain or plain in PLACEHOLDERS


def is_refusal(response: str) -> bool:
    """Sentences that align with refusal templates make up the response; a name, a greeting or a plea may stand beside them.

    A sentence is aligned by the longest common subsequence of tokens with a template whose shingles it mostly contains,
    and what is left of it with further templates.  Other sentences may have ``SMALL_TALK`` tokens; what is left of the
    aligned ones must be well less than what was aligned.
    """
    matched = rest = 0
    for sentence in _SENTENCE.split(response):
        tokens = _plain_tokens(sentence)
        if not tokens:
            continue
        whole = len(tokens)
        while tokens and (kept := _aligned(tokens)) is not None:
            tokens = kept
        if len(tokens) == whole and whole > SMALL_TALK * (1 + (_letters(tokens) <= whole)):
            return False
        matched += whole - len(tokens)
        rest += len(tokens)
    return matched > 0 and rest <= max(SMALL_TALK, 0.6 * matched)


def _letters(tokens: list[str]) -> int:
    return sum(map(len, tokens))


#: Ways to write the same word.
_SAME_WORD = {"cannot": ("can", "t"), "not": ("t",), "won": ("will",), "am": ("m",), "would": ("d",), "is": ("s",), "assist": ("help",)}
#: Tokens of a sentence that is no part of the answer, such as a greeting or a name; twice as many where they are single characters.
SMALL_TALK = 3
#: Shares of a template's shingles that must be contained, and of its tokens that must align in order.
CONTAINED, IN_ORDER = 0.4, 0.7


def _plain_tokens(text: str) -> list[str]:
    """Words of alphabetic scripts, single characters of the others, in one spelling."""
    plain = bare_words(text)
    return [t for word in plain for t in (_SAME_WORD.get(word, (word,)) if word.isascii() else (word,) if not _BY_CHARACTER.search(word) else tuple(word))]


_BY_CHARACTER = re.compile(r"[\u0e01-\u0e4e\u3040-\u30ff\u3400-\u9fff]")


def bare_words(text: str) -> list[str]:
    """The words of a text in the bare form."""
    return [b for word in re.split(r"[^\w\u0300-\u036f\u064b-\u065f\u0900-\u0963\u0e31-\u0e4e]+", text) if (b := bare(word))]


def _shingles(tokens: list[str]) -> set[str]:
    """Pairs of neighbouring tokens."""
    return {f"{a} {b}" for a, b in zip(tokens, tokens[1:])}


_TEMPLATES = [(t, _shingles(t)) for t in map(list, dict.fromkeys(tuple(_plain_tokens(r)) for r in REFUSALS))]
_TEMPLATES_OF: dict[str, list[int]] = {}
for _number, (_, _set) in enumerate(_TEMPLATES):
    for _shingle in _set:
        _TEMPLATES_OF.setdefault(_shingle, []).append(_number)


def _aligned(tokens: list[str]) -> list[str] | None:
    """What is left of the tokens when those that align with the best template are taken out; None if none aligns."""
    votes = Counter(n for s in _shingles(tokens) for n in _TEMPLATES_OF.get(s, ()))
    likely = []
    for number, count in votes.items():
        template, shingles = _TEMPLATES[number]
        if count >= CONTAINED * len(shingles):
            common = round(_lcs_share(template, tokens) * len(template))
            if common >= max(2, IN_ORDER * len(template)):
                likely.append((-common, number))
    for _, number in sorted(likely):
        places = _common_places(_TEMPLATES[number][0], tokens)
        # The template must stand together: it may be stretched by a few words, not spread over the sentence.
        if places[-1] - places[0] < 1.5 * len(places) + 4:
            taken = set(places)
            return [t for i, t in enumerate(tokens) if i not in taken]
    return None


def _common_places(a: list[str], b: list[str]) -> list[int]:
    """Places in ``b`` of a longest common subsequence of two token lists."""
    rows = [[0] * (len(b) + 1)]
    for x in a:
        last, row = rows[-1], [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        rows.append(row)
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i][j] == rows[i - 1][j]:
            i -= 1
        elif rows[i][j] == rows[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append(j)
    return out[::-1]


def _lcs_share(a: list[str], b: list[str]) -> float:
    """Length of the longest common subsequence of two token lists, as a share of the first (bit-parallel)."""
    if not a:
        return 0.0
    where: dict[str, int] = {}
    for i, token in enumerate(a):
        where[token] = where.get(token, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for token in b:
        hit = row & where.get(token, 0)
        row = ((row + hit) | (row - hit)) & full
    return (len(a) - row.bit_count()) / len(a)


def _tokens(text: str) -> list[str]:
    """Words, single characters of dense scripts."""
    return re.findall(r"[぀-ヿ㐀-鿿]|[^\W_぀-ヿ㐀-鿿]+", unicodedata.normalize("NFKC", text).casefold())


def is_copy(prompt: str, response: str) -> bool:
    """The response is the prompt's own wording, once or more, with at most a label or quotes around it."""
    p, r = bare(prompt), bare(response)
    if len(r) < 8 or len(p) < 8:
        return bool(r) and r == p
    shingles = {p[i : i + SHINGLE] for i in range(len(p) - SHINGLE + 1)}
    held = sum(r[i : i + SHINGLE] in shingles for i in range(len(r) - SHINGLE + 1))
    whole = len(r) - SHINGLE + 1
    if held < 0.75 * whole or whole - held > max(24, 0.12 * whole):
        return False
    a, b = _tokens(response), _tokens(prompt)
    return _lcs_share(a, b * max(1, -(-len(a) // max(1, len(b))))) >= 0.75


def _plainly_one(text: str) -> str | None:
    """The language of nearly all of the text, judged as a whole; None where sentences must be looked at."""
    scripts = {name: n for name, find in _SCRIPTS if (n := sum(map(len, find(text))))}
    if not scripts:
        return None
    name, total = max(scripts, key=scripts.get), sum(scripts.values())
    if kana := scripts.get("kana"):  # Japanese is mixed, but so is Chinese beside a Japanese sentence
        return "ja" if kana >= 0.4 * total and kana + scripts.get("han", 0) >= 0.9 * total else None
    if scripts[name] < 0.9 * total:
        return None
    if name != "latin":
        return {"han": "zh"}.get(name, name)
    votes: Counter = Counter()
    for word in _WORDS.findall(text.lower()):
        known = _WORD_LANGUAGE.get(word)
        if known and len(known) == 1:
            votes[next(iter(known))] += 1
    best = votes.most_common(1)
    return best[0][0] if best and best[0][1] >= 4 and best[0][1] >= 0.9 * votes.total() else None


def is_other_language(prompt: str, response: str) -> bool:
    """Most letters of the response are in another language than the prompt, which did not ask for it."""
    plain = _plainly_one(response)
    if plain is not None and plain == _plainly_one(prompt):
        return False
    mine, theirs = main_language(languages(prompt)), languages(response)
    if mine is None:
        return False
    known = {k: v for k, v in theirs.items() if k != "latin"}
    total = sum(known.values())
    if not total:
        return False
    if known.get(mine, 0) >= 0.5 * total:
        return False
    other = max((k for k in known if k != mine), key=known.get)
    return other not in asked_language(prompt)


def _open_quotes(text: str) -> bool:
    """Whether a quotation stays open at the end; nested marks of other kinds do not matter."""
    text = re.sub("„[^“”„]*[“”]", "", text)
    return any(text.count(a) > text.count(b) for a, b in (("“", "”"), ("«", "»"), ("「", "」"), ("『", "』"), ("„", "“"))) or text.count('"') % 2 == 1


def is_truncated(response: str) -> bool:
    """Stops amid a word, sentence, list, quotation or block."""
    text = _INVISIBLE.sub("", response).rstrip()
    if not text:
        return False
    if text.count("```") % 2:
        return True
    if text.endswith("```"):
        return False
    lines = text.split("\n")
    last = lines[-1].strip()
    core = last.strip("*_~> ")
    if not core:
        return False
    if _NUMBERED_MARK.fullmatch(core + " ") or core in ("-", "*", "•", "–"):
        return True  # a list mark without an item
    if any(core.count(a) > core.count(b) for a, b in (("(", ")"), ("（", "）"), ("[", "]"), ("{", "}"))):
        return True
    if _open_quotes(text):
        return True
    if _ENDS.search(core):
        return False
    if unicodedata.category(core[-1]) in ("So", "Sk", "Mn", "Cf", "Sm") and not unicodedata.name(core[-1], "").startswith(("THAI", "DEVANAGARI", "ARABIC", "HEBREW")):
        return False  # closes with a sign such as a smiley
    if core[-1] in ",;:、，；：-–—،" or core[-1] in "([{（「«“":
        return True
    mark = _LIST_MARK.match(last)
    if mark and not _NUMBERED_MARK.match(last):
        item = last[mark.end() :].strip()
        # Items of a list need no full stop, if the last is whole like those before it.
        label, colon, value = item.partition(":")
        before = [x.strip() for x in lines[:-1] if _LIST_MARK.match(x) and not _NUMBERED_MARK.match(x)]
        return not item or bool(colon) and not value.strip() or bool(before) and all(_ENDS.search(x) for x in before)
    if mark and len(lines) > 1:
        before = [x.strip() for x in lines[:-1] if _NUMBERED_MARK.match(x)]
        return not before or all(_ENDS.search(x) for x in before)
    return True


def defect(prompt: str | None, response: str | None) -> str | None:
    """The defect of a pair, or None."""
    if is_empty(response):
        return "empty"
    if is_refusal(response):
        return "refusal"
    if prompt and prompt.strip():
        if is_copy(prompt, response):
            return "copy_prompt"
        if is_other_language(prompt, response):
            return "other_language"
    return "truncated" if is_truncated(response) else None


def broken_pairs(df: DataFrame, key: str, prompt: str, response: str, label: str) -> DataFrame:
    """(``key``, ``defect``) of the records with a label and a defective response; narrow, whole texts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [defect(p, r) for p, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            at = pa.array([i for i, d in enumerate(found) if d], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([d for d in found if d], pa.string())], [key, "defect"])

    kind = df.select(key).schema[0].dataType.simpleString()
    source = df.where(F.col(label).isNotNull()).select(F.col(key), F.col(prompt).cast("string").alias("__p"), F.col(response).cast("string").alias("__r"))
    return spread(source).mapInArrow(scan, f"`{key}` {kind}, defect string")
