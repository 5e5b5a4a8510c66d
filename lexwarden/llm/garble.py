"""Text read in a wrong encoding: finding it and restoring what can be had (problem 9).

Four ways of misreading are told apart:

* UTF-8 read in a single-byte code page: the garbled sequence of every character of a repertoire is computed for every
  page, and one Aho-Corasick automaton over all of them scans the text; only matched spans are turned back;
* UTF-8 read in a double-byte code page: stretches, written back in that page, are runs of UTF-8 sequences; what the page
  does not have ends a stretch;
* a legacy code page read in a Western one: words made of upper-half characters only, or control characters, that turn
  into one script when read in the legacy page;
* bytes that were no UTF-8 read as UTF-8: replacement characters, which cannot be turned back.

Correct text beside garbled spans stays as it is.

Defined results: null and empty texts are not garbled; escapes, entities, decomposed letters, single symbols and single
accented words are not garbled.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexwarden.session import spread

#: Code pages in which UTF-8 is misread, most usual first, and legacy pages misread as Western ones.
SINGLE_PAGES = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1256", "cp1250", "cp1254", "cp1253", "cp1258", "cp874", "koi8-r", "iso8859-15", "iso8859-2")
DOUBLE_PAGES = ("gb18030", "cp932", "big5", "euc_kr")
WESTERN_PAGES = ("cp1252", "mac_roman", "cp437", "cp850")
LEGACY_PAGES = ("cp1256", "cp874", "euc_jp", "cp932", "gbk", "big5", "euc_kr", "iso8859-6", "koi8-r", "cp1251")
#: Pages whose upper half holds letters of a living script, where short sequences occur in right text.
LETTER_PAGES = frozenset(("cp1251", "cp1256", "cp1253", "cp874", "koi8-r"))
#: The repertoire whose garbled sequences are computed, as code point ranges.
REPERTOIRE = (
    (0x00A0, 0x017F), (0x01A0, 0x01B0), (0x0300, 0x036F), (0x0600, 0x06FF), (0x0900, 0x097F), (0x0E00, 0x0E5B), (0x1E00, 0x1EFF),
    (0x2010, 0x203A), (0x20AC, 0x20AC), (0x2100, 0x2122), (0x3000, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0xFF01, 0xFF9F), (0x1F300, 0x1F6FF),
)
_UTF8 = rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2})"
_UTF8_RUN = re.compile(_UTF8 + rb"+")
#: What spans of far scripts have in bytes, and spans of Western letters and signs in characters.
_FAR_BYTES = re.compile(rb"(?:[\xe0-\xef][\x80-\xbf]{2}){2}|(?:[\xd8-\xdb][\x80-\xbf]){6}")
_WESTERN_IN_DOUBLE = re.compile(r"[A-Za-z] ?[一-鿿ｦ-ﾟ]|[一-鿿ｦ-ﾟ]{1,2} ?[A-Za-z]|(?<!\S)(?:[一-鿿]|ﾂ[ｦ-ﾟ]) ")
#: Words of characters that upper halves of Western pages hold: Latin, Greek, signs, box drawing.
_HIGH_WORD = re.compile("[\x80-\u024f\u02b0-\u03ff\u2010-\u25ff\ufb01\ufb02\uf8ff]{3,}")
_CONTROL = re.compile(r"[\x80-\x84\x86-\x9f]")
#: Double-byte kana read in a Western page: the lead bytes show as these two characters, again and again.
_KANA_BYTES = re.compile(r"(?:[ƒ‚][^\s]){3,}|(?:ƒ[^\s]){2,}")
#: The same of the other double-byte page of Japanese.
_EUC_KANA_BYTES = re.compile(r"(?:[¥¤][¡-ö]){2,}")
#: A sign of a double-byte page that stands alone.
_LONE_SIGN = re.compile(r"(?<!\S)(?:¡[¡-þ]|\x81[^\s\x00-\x7f])(?!\S)")
_NOT_ASCII = re.compile(r"[^\x00-\x7f]+")
_FAR = re.compile(r"[㐀-鿿-｡-ﾟ가-힣]")
_NEAR_LETTER = re.compile(r"[A-Za-z]")


@lru_cache(maxsize=32)
def upper_half(page: str) -> dict[int, str]:
    """Byte -> character for the upper half of a page; bytes without one are the control characters of that number."""
    return {b: bytes([b]).decode(page, "ignore") or chr(b) for b in range(0x80, 0x100)}


@lru_cache(maxsize=32)
def _back(page: str) -> dict[str, int]:
    return {c: b for b, c in reversed(upper_half(page).items())}


def to_bytes(text: str, page: str) -> bytes | None:
    """The bytes that read as ``text`` in a single-byte page, or None."""
    back = _back(page)
    out = bytearray()
    for c in text:
        b = ord(c) if c < "\x80" else back.get(c, -1)
        if b < 0:
            return None
        out.append(b)
    return bytes(out)


def _strong(sequence: str) -> bool:
    """Whether the characters hardly stand side by side in right text: some is no letter."""
    if any(unicodedata.category(c)[0] != "L" or c in "ªº" for c in sequence) or sequence[0] in "ÿΓ":
        return True
    return any(a.islower() and b.isupper() for a, b in zip(sequence, sequence[1:]))


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """All garbled sequences: sequence -> (length, character meant, page number, strong)."""
    machine = ahocorasick.Automaton()
    for number, page in enumerate(SINGLE_PAGES):
        upper = upper_half(page)
        for low, high in REPERTOIRE:
            for code in range(low, high + 1):
                garbled = "".join(map(upper.__getitem__, chr(code).encode()))
                if garbled not in machine:
                    machine.add_word(garbled, (len(garbled), code, number, _strong(garbled)))
    machine.make_automaton()
    return machine


def _utf8_in_single(text: str) -> list[tuple[int, int, str]]:
    """Spans (from, to, meant) of UTF-8 read in a single-byte page, when the evidence holds."""
    hits: list[tuple[int, int, int, int, bool]] = []
    for end, (size, code, page, strong) in automaton().iter(text):
        hit = (end - size + 1, end + 1, code, page, strong)
        if hits and hit[0] < hits[-1][1]:  # overlap: the longer sequence
            if size <= hits[-1][1] - hits[-1][0]:
                continue
            hits.pop()
        hits.append(hit)
    if not hits:
        return []
    hits = _covering(text, hits)
    if not hits:
        return []
    good: list[tuple[int, int, str]] = []
    run: list[tuple[int, int, int, int, bool]] = []

    def settle() -> None:
        strong = sum(h[4] for h in run)
        longest = max(h[1] - h[0] for h in run)
        low, high = run[0][0], run[-1][1]
        page = SINGLE_PAGES[run[0][3]]
        if page in LETTER_PAGES:
            # Right text of that script has no such run of letter and symbol in turn.
            holds = strong >= 3 or (strong >= 2 and longest >= 3) or (longest >= 3 and strong >= 1 and _beside_latin(text, low, high))
            holds = holds or (strong >= 1 and page != "cp1256" and _beside_latin(text, low, high))
            # Within a Latin word a letter of another script and its neighbour are no right text.
            holds = holds or (page == "cp1251" and text[low] == "Г" and all("À" <= chr(h[2]) <= "ỹ" for h in run) and bool(_NEAR_LETTER.search(text[max(0, low - 1) : low] + text[high : high + 1])))
        else:
            holds = (longest >= 3 and strong >= 1) or len(run) >= 3 or strong >= 2 or (strong >= 1 and _beside_latin(text, low, high))
        # Punctuation whose garbled form is all letters.
        holds = holds or (longest >= 3 and any(0x2010 <= h[2] <= 0x203A for h in run) and page not in LETTER_PAGES and _beside_latin(text, low, high))
        # A capital inside a word, or a section sign and its like standing alone.
        holds = holds or (text[low].isupper() and "a" <= text[low - 1 : low] <= "z" and page not in LETTER_PAGES)
        holds = holds or (len(run) == 1 and strong == 1 and chr(run[0][2]) in "§°·«»©®±" and not text[low - 1 : low].strip() and not text[high : high + 1].strip())
        if holds:
            good.extend((h[0], h[1], chr(h[2])) for h in run)

    for hit in hits:
        if run and hit[0] - run[-1][1] > 0:
            settle()
            run = []
        run.append(hit)
    settle()
    if good and len(good) < len(hits):  # beside sure spans of a page, single sequences of it count too
        pages = {h[3] for h in hits if (h[0], h[1], chr(h[2])) in set(good)}
        joined = [h for h in hits if h[3] in pages and (SINGLE_PAGES[h[3]] not in LETTER_PAGES or text[h[0] - 1 : h[0]].isascii() and _NEAR_LETTER.search(text[max(0, h[0] - 1) : h[0]] + text[h[1] : h[1] + 1]))]
        good = sorted({*good, *((h[0], h[1], chr(h[2])) for h in joined)})
    return good


def _covering(text: str, hits: list[tuple[int, int, int, int, bool]]) -> list[tuple[int, int, int, int, bool]]:
    """The hits in stretches of upper-half characters that hits make up for the most part.

    Text of a legacy page also has a sequence here and there, but only by chance.
    """
    out: list[tuple[int, int, int, int, bool]] = []
    i = 0
    while i < len(hits):
        back = _back(SINGLE_PAGES[hits[i][3]])
        low, high = hits[i][0], hits[i][1]
        while low > 0 and text[low - 1] in back:
            low -= 1
        while high < len(text) and text[high] in back:
            high += 1
        inside = [h for h in hits[i:] if h[0] < high]
        if sum(h[1] - h[0] for h in inside) >= 0.6 * (high - low):
            out += inside
        i += len(inside)
    return out


def _beside_latin(text: str, low: int, high: int) -> bool:
    """Whether a letter of English stands at either end, a blank between set aside."""
    return bool(_NEAR_LETTER.search(text[max(0, low - 2) : low]) or _NEAR_LETTER.search(text[high : high + 2]))


@lru_cache(maxsize=1 << 16)
def _double_bytes(char: str, page: str) -> bytes:
    """The bytes of a character in the page, none if the page does not have it."""
    return char.encode(page, "ignore")


def _double_spans(text: str, page: str) -> list[tuple[int, int, str]]:
    """Spans (from, to, meant) of characters that are UTF-8 when written in the page.

    Characters that the page does not have, such as a replacement character, end a span.  A span is whole characters, so
    what its first and last share with ASCII neighbours in bytes is read as well.
    """
    out = []
    for m in _NOT_ASCII.finditer(text):
        parts = [_double_bytes(c, page) or b"\n" for c in m.group()]  # a new line breaks any sequence
        raw, edges = b"".join(parts), [0]
        for part in parts:
            edges.append(edges[-1] + len(part))
        number, done = {edge: i for i, edge in enumerate(edges)}, 0
        for first, edge in enumerate(edges[:-1]):
            if edge < done or not (run := _UTF8_RUN.match(raw, edge)):
                continue
            ends = [edge + at for at in _sequence_ends(run.group())]
            while ends:
                rest = next(e for e in edges if e >= ends[-1])
                if all(x < 0x80 for x in raw[ends[-1] : rest]):
                    break
                ends.pop()
            if ends:
                done = rest
                out.append((m.start() + first, m.start() + number[rest], raw[edge:rest].decode()))
    return out


def _sequence_ends(run: bytes) -> list[int]:
    """Where each sequence of a UTF-8 run ends, up to the first that is no usual character: right text may follow."""
    ends, at = [], 0
    for c in run.decode():
        if not _usual(c):
            break
        at += len(c.encode())
        ends.append(at)
    return ends


def _rare(span: str) -> bool:
    """Whether no character of the span is a usual one of simplified Chinese or Japanese."""
    return not any(c.encode("gb2312", "ignore") or c.encode("shift_jis", "ignore") for c in span)


def _utf8_in_double(text: str) -> list[tuple[int, int, str]]:
    """Spans (from, to, meant) of UTF-8 read in a double-byte page, when the evidence holds."""
    western = _WESTERN_IN_DOUBLE.search(text)
    for page in DOUBLE_PAGES:
        if not (western and page in ("gb18030", "cp932")) and not _FAR_BYTES.search(text.encode(page, "replace")):
            continue
        spans = _double_spans(text, page)
        long = [s for s in spans if sum(c >= "\u0800" for c in s[2]) >= 2 or sum("\u0600" <= c <= "\u06ff" for c in s[2]) >= 6]
        letters = [c for s in long for c in s[2] if c >= "\x80"]
        usual = sum(map(_usual, letters)) >= 0.8 * len(letters)
        holds = bool(long) and usual and (max(len(s[2]) for s in long) >= 4 or len(letters) >= 6)
        # A name or two: kana written with the rare characters of their lead bytes, or characters none of which is usual.
        holds = holds or bool(long) and page == "cp932" and any(sum("\u3041" <= c <= "\u30ff" for c in m) >= 2 and text[low] in "縲縺繝繧" for low, _, m in long)
        holds = holds or bool(long) and usual and page == "gb18030" and all(_rare(text[low:high]) for low, high, _ in long) and not _rare_elsewhere(text, long)
        lone = [s for s in spans if s[1] - s[0] <= 2 and (m := [c for c in s[2] if c >= "\x80"]) and len(m) == 1 and ("À" <= m[0] <= "ɏ" or m[0] in "¿¡ªº") and _beside_latin(text, s[0], s[1])]
        touching = sum(bool(_NEAR_LETTER.search(text[max(0, low - 1) : low] + text[high : high + 1])) for low, high, _ in lone)
        # Signs that stand alone, as a section sign before its number; the sign in that page is no word of Latin text.
        signs = [s for s in spans if s[1] - s[0] <= 2 and s[2] in ("§", "°", "«", "»", "©", "®", "±") and not text[max(0, s[0] - 1) : s[0]].strip() and text[s[1] : s[1] + 1] == " "]
        only = {i for low, high, _ in lone + signs for i in range(low, high)}
        whole = bool(only) and (touching or signs) and all(i in only for i, c in enumerate(text) if _FAR.match(c))
        if not holds and (page not in ("gb18030", "cp932") or touching < 2 and not whole):
            continue
        lone += signs
        # A single one belongs to the letters of its script beside it.
        alike = lambda m, c: bool(c) and c >= "\x80" and _script(m) == _script(c) and _script(m) in ("arabic", "cyrillic", "thai")
        return [s for s in spans if s in lone or len(s[2]) >= 2 or s[1] - s[0] >= 2 or alike(s[2][-1], text[s[1] : s[1] + 1]) or alike(s[2][0], text[max(0, s[0] - 1) : s[0]])]
    return []


def _rare_elsewhere(text: str, spans: list[tuple[int, int, str]]) -> bool:
    """Whether rare Han characters also stand outside of the spans, as in traditional text."""
    inside = {i for low, high, _ in spans for i in range(low, high)}
    han = [c for i, c in enumerate(text) if "\u4e00" <= c <= "\u9fff" and i not in inside]
    return sum(map(_rare, han)) > max(1, 0.1 * len(han))


def _usual(c: str) -> bool:
    """Characters of the scripts in use, and their punctuation."""
    return "　" <= c <= "ヿ" or "一" <= c <= "鿿" or "؀" <= c <= "ۿ" or "ऀ" <= c <= "ॿ" or "฀" <= c <= "๛" or "¡" <= c <= "ɏ" or "Ạ" <= c <= "ỹ" or "‐" <= c <= "›" or "！" <= c <= "｠" or "̀" <= c <= "ͯ" or "\u2600" <= c <= "\u27bf" or "\U0001f300" <= c <= "\U0001faff"


def _script(c: str) -> str:
    if "؀" <= c <= "ۿ":
        return "arabic"
    if "฀" <= c <= "๛":
        return "thai"
    if "぀" <= c <= "ヿ":
        return "kana"
    if "一" <= c <= "鿿":
        return "han"
    if "가" <= c <= "힣":
        return "hangul"
    if "Ѐ" <= c <= "ӿ":
        return "cyrillic"
    if "　" <= c <= "〿" or "！" <= c <= "｠" or unicodedata.category(c)[0] in "PN":
        return "mark"
    return "other"


#: Fixed value: the script that text of a legacy page shows.
_WANTED = {"cp1256": ("arabic",), "iso8859-6": ("arabic",), "cp874": ("thai",), "euc_jp": ("kana", "han"), "cp932": ("kana", "han"), "gbk": ("han",), "big5": ("han",), "euc_kr": ("hangul",), "koi8-r": ("cyrillic",), "cp1251": ("cyrillic",)}


#: Legacy pages of two bytes a character.
_DOUBLE_LEGACY = frozenset(("euc_jp", "cp932", "gbk", "big5", "euc_kr"))
#: Lead bytes of the usual characters of double-byte pages, where nearly any bytes are characters.
_USUAL_LEAD = {"gbk": ("gb2312", 0xB0, 0xD7), "big5": ("big5", 0xA4, 0xC6), "euc_jp": ("euc_jp", 0xB0, 0xCF), "cp932": ("cp932", 0x88, 0x97)}


def _plausible(legacy: str, meant: list[str], kinds: list[str]) -> float:
    """How much the reading looks like text of its language, from 0 to 1."""
    if legacy == "cp874":
        # Marks stand on consonants; a mark after anything else is no Thai.
        odd = sum(unicodedata.category(c) == "Mn" and not ("ก" <= p <= "ฮ" or unicodedata.category(p) == "Mn") for p, c in zip([" ", *meant], meant))
        rare = sum(c in "ฃฅฆฌฎฏฐฑฒฤฦฬฯ๏๐๑๒๓๔๕๖๗๘๙๚๛" for c in meant)
        return max(0.0, 1 - 6 * odd / len(meant) - 2 * rare / len(meant))
    if legacy in _USUAL_LEAD:
        page, low, high = _USUAL_LEAD[legacy]
        han = [c for c, k in zip(meant, kinds) if k == "han"]
        usual = sum(len(e := c.encode(page, "ignore")) == 2 and low <= e[0] <= high for c in han)
        kana = min(1.0, 4 * kinds.count("kana") / len(meant)) if legacy in ("euc_jp", "cp932") else 1.0
        return kana * (usual / len(han) if han else 1.0)
    return 0.8 if legacy in ("cp1251", "koi8-r") else 1.0


@lru_cache(maxsize=1 << 16)
def _unit(raw: bytes, legacy: str) -> str:
    """The one character that the bytes are in the legacy page, or nothing."""
    try:
        meant = raw.decode(legacy)
    except UnicodeDecodeError:
        return ""
    return meant if len(meant) == 1 and meant >= "\xa0" else ""


class _Stretch:
    """Neighbouring characters of a Western page, blanks, digits and signs between them set aside, read in a legacy page.

    ``units``: (from, to, meant) of each character, meant is U+FFFD where the legacy page has none.
    """

    def __init__(self, units: list[tuple[int, int, str]]) -> None:
        self.units = units
        self.meant = [m for _, _, m in units]
        self.kinds = [_script(m) for m in self.meant]

    def share(self, legacy: str) -> float:
        """How far the reading is text of the legacy page's script, from 0 to 1."""
        right = sum(k in _WANTED[legacy] for k in self.kinds)
        return (right + 0.5 * self.kinds.count("mark")) / len(self.meant) * _plausible(legacy, self.meant, self.kinds)


def _read_run(text: str, low: int, high: int, codes: list[int], legacy: str) -> list[tuple[int, int, str]]:
    """The characters of a run of upper-half characters in the legacy page; the last may take an ASCII trail byte beyond ``high``."""
    sizes = ((3, 2, 1) if legacy == "euc_jp" else (2, 1)) if legacy in _DOUBLE_LEGACY else (1,)
    out, at = [], low
    while at < high:
        for size in sizes:
            part = codes[at : at + size]
            if len(part) == size and min(part) >= 0 and (meant := _unit(bytes(part), legacy)):
                break
        else:
            size, meant = 1, "\ufffd"
        out.append((at, at + size, meant))
        at += size
    return out


def _stretches(text: str, western: str, legacy: str) -> list[_Stretch]:
    """The stretches of the text that can be written in the Western page.

    Any other character ends a stretch, also an ASCII letter that is no trail byte and a new line, so that right text on
    the same line stays out.  A few upper-half letters within a Western word are that word's own.
    """
    back = _back(western)
    codes = [ord(c) if c < "\x80" else back.get(c, -1) for c in text]
    out: list[_Stretch] = []
    units: list[tuple[int, int, str]] = []
    at, n = 0, len(text)
    while at < n:
        if codes[at] < 0x80:
            if units and (codes[at] < 0 or text[at].isalpha() or text[at] == "\n"):
                out.append(_Stretch(units))
                units = []
            at += 1
            continue
        low = at
        run: list[tuple[int, int, str]] = []
        while at < n and codes[at] >= 0x80:  # an ASCII trail byte may lie between
            high = at
            while high < n and codes[high] >= 0x80:
                high += 1
            part = _read_run(text, at, high, codes, legacy)
            if legacy in _DOUBLE_LEGACY and high - at > 2:  # a right sign or letter may stand before the lead byte
                other, gain = _read_run(text, at + 1, high, codes, legacy), 0.1
                if unicodedata.category(text[at])[0] != "P" and all(m != "\ufffd" for _, _, m in part):
                    gain = 0.4 if high - at >= 8 else 2
                if _Stretch(other).share(legacy) > _Stretch(part).share(legacy) + gain:
                    part = [(at, at + 1, "")] + other
            run += part
            at = part[-1][1]
        held = text[low:at]
        beside = _NEAR_LETTER.search(text[low - 1 : low] + text[at : at + 1] if low else text[at : at + 1]) or _NEAR_LETTER.search(held)
        if beside and sum(c >= "\x80" for c in held) < (3 if legacy in _DOUBLE_LEGACY else 4) and all(c.isalpha() for c in held):
            if units:
                out.append(_Stretch(units))
                units = []
            continue
        units += [u for u in run if u[2]]
    if units:
        out.append(_Stretch(units))
    return out


def _legacy(text: str) -> tuple[str, str] | None:
    """(Western page, legacy page) if upper-half words of the text are one script in a legacy page."""
    if _KANA_BYTES.search(text):
        return "cp1252", "cp932"
    if _EUC_KANA_BYTES.search(text):
        return "cp1252", "euc_jp"
    words = _HIGH_WORD.findall(text)
    if all(w.isalpha() and (w.isupper() or w.islower()) for w in words):
        words = []  # may be words of a Western language
    controls = len(_CONTROL.findall(text))
    if sum(map(len, words)) < 6 and controls < 3:
        return None
    best: tuple[float, str, str] | None = None
    for western in WESTERN_PAGES:
        back = _back(western)
        inside = [w for w in words if all(c in back for c in w) and sum(unicodedata.category(c)[0] in "LS" and not "\u2500" <= c <= "\u259f" for c in w) >= 2]
        for legacy in LEGACY_PAGES:
            if legacy in _DOUBLE_LEGACY:
                if western == "mac_roman":
                    continue
                # Double bytes may take in ASCII, so stretches are read; single bytes need the words only.
                parts = [s for s in _stretches(text, western, legacy) if sum(c >= "\x80" for low, high, _ in s.units for c in text[low:high]) >= 8]
                whole = _Stretch([u for s in parts for u in s.units])
            elif sum(map(len, inside)) < 6:
                continue
            else:
                raw = b" ".join(to_bytes(w, western) or b"" for w in inside)
                whole = _Stretch([(0, 0, c) for c in raw.decode(legacy, "replace") if c >= "\x80"])
            if len(whole.meant) < 3:
                continue
            share = whole.share(legacy)
            if share > (best[0] if best else 0.75):
                best = (share, western, legacy)
    if best:
        return best[1], best[2]
    # A long word of upper-half letters only is no word of a Western language, whatever it was.
    back = _back("cp1252")
    odd = any(len(w) >= 6 and all(c in back for c in w) and sum(unicodedata.category(c)[0] == "L" for c in w) >= 4 for w in words)
    return ("cp1252", "gbk") if odd else None


def examine(text: str | None) -> tuple[str, str | None] | None:
    """(way of misreading, restored text or None) of a garbled text; None if it is not garbled."""
    if not text or text.isascii():
        return None
    way, restored = None, text
    spans, pages = _utf8_in_single(text), None
    if spans and 2 * sum(b - a for a, b, _ in spans) < sum(map(len, _HIGH_WORD.findall(text))):
        pages = _legacy(text)  # sequences by chance within text of a legacy page
    if spans and not pages:
        way = "utf-8 in a single-byte page"
        restored = _turned(text, spans)
        again = _utf8_in_single(restored)  # misread twice
        if again:
            return way, examine(restored)[1]
    elif not pages and _FAR.search(text) and (doubled := _utf8_in_double(text)):
        way = "utf-8 in a double-byte page"
        restored = _turned(text, doubled)
        if any("?" in (text[low - 1 : low], text[high : high + 1]) for low, high, _ in doubled):
            restored = None  # a question mark took the place of what the page does not have
    elif pages := pages or _legacy(text):
        way = "legacy page in a Western page"
        restored = _turn_words(text, *pages)
    elif "�" in text:
        return "no utf-8", None
    elif _LONE_SIGN.search(text):
        return "legacy page in a Western page", _LONE_SIGN.sub(_sign, text)
    elif _CONTROL.search(text):
        return "control characters", _controls(text)
    if way is None:
        return None
    lost = restored is None or "�" in restored or _CONTROL.search(restored)
    return way, None if lost else restored


def _turned(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with what was meant in place of the spans; everything else stays."""
    parts, at = [], 0
    for low, high, meant in spans:
        parts += [text[at:low], meant]
        at = high
    return "".join([*parts, text[at:]])


def _sign(m: re.Match) -> str:
    """The sign of a double-byte page, or what stands there if there is none."""
    first, second = (ord(c) if ord(c) < 0x100 else _back("cp1252").get(c, 0) for c in m.group())
    meant = bytes((first, second)).decode("euc_jp" if first == 0xA1 else "cp932", "ignore")
    return meant if len(meant) == 1 else m.group()


def _controls(text: str) -> str | None:
    """The text with control characters read as the Western page's signs of those bytes; None if one has no sign."""
    out = _CONTROL.sub(lambda m: m.group().encode("latin-1").decode("cp1252", "ignore") or m.group(), text)
    return None if _CONTROL.search(out) else out


def _turn_words(text: str, western: str, legacy: str) -> str | None:
    """Rereads the stretches that are text of the legacy page; everything else stays.  None if garbled runs are left."""
    parts, at, left = [], 0, False
    found = [(s, text.count("\n", 0, s.units[0][0])) for s in _stretches(text, western, legacy)]
    clean = [all(k in (*_WANTED[legacy], "mark") for k in s.kinds) for s, _ in found]
    sure = [len(s.meant) >= 3 and sum(k in (*_WANTED[legacy], "mark") for k in s.kinds) >= 0.8 * len(s.meant) and s.share(legacy) > 0.4 for s, _ in found]
    lines = {line for (_, line), is_sure in zip(found, sure) if is_sure}
    for (s, line), is_clean, is_sure in zip(found, clean, sure):
        high_ones = [c for low, high, _ in s.units for c in text[low:high] if c >= "\x80"]
        # Short ones are taken where they are no Western word: beside sure ones, or with signs in them, or kana.
        if is_sure or is_clean and (len(high_ones) > 1 or not high_ones[0].isalpha()) and (len(high_ones) >= 4 or line in lines or "kana" in s.kinds or not all(map(str.isalpha, high_ones))):
            for low, high, meant in s.units:
                if meant != "\ufffd":
                    parts += [text[at:low], meant]
                    at = high
                else:
                    left = left or text[low].isalpha()
    restored = "".join([*parts, text[at:]])
    back = _back(western)
    left = left or any(sum(unicodedata.category(c)[0] in "LS" and not "\u2500" <= c <= "\u259f" for c in w) >= 2 for w in _HIGH_WORD.findall(restored) if all(c in back for c in w))
    return None if left or restored == text else restored


def garbled_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(``key``, ``way``, ``restored``) of the garbled texts; ``restored`` is null where it cannot be had whole.  Narrow."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, r) for i, t in enumerate(batch.column(1).to_pylist()) if (r := examine(t)) is not None]
            at = pa.array([i for i, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), pa.array([r[0] for _, r in found], pa.string()), pa.array([r[1] for _, r in found], pa.string())], [key, "way", "restored"]
            )

    kind = df.select(key).schema[0].dataType.simpleString()
    source = df.select(F.col(key), F.col(text).cast("string").alias("__text")).where(F.col("__text").isNotNull())
    return spread(source).mapInArrow(scan, f"`{key}` {kind}, way string, restored string")
