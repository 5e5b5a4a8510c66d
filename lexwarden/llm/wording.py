"""Normal forms of text for matching wording: letters and digits only, case and Unicode form set aside."""

from __future__ import annotations

import re
import unicodedata

import numpy as np


class _Folding(dict):
    """Character -> its normal form, filled as characters are met.  ``marks``: whether combining marks are kept."""

    def __init__(self, marks: bool) -> None:
        super().__init__()
        self.keep = "LNM" if marks else "LN"
        self.form = "NFKC" if marks else "NFKD"

    def __missing__(self, code: int) -> str:
        folded = unicodedata.normalize(self.form, unicodedata.normalize("NFKD", chr(code)).casefold())
        out = self[code] = "".join(c for c in folded if unicodedata.category(c)[0] in self.keep)
        return out


_BARE = _Folding(marks=False)
_MARKED = _Folding(marks=True)
#: A markup tag: a name, then attributes with or without values.
_TAG = re.compile(r"""</?[A-Za-z][\w:-]*+(?:\s++[\w:@.-]++(?:\s*+=\s*+(?:"[^"<>]*+"|'[^'<>]*+'|[^\s"'<>]++))?+)*+\s*+/?>""")


def bare(text: str) -> str:
    """Letters and digits without case and combining marks; markup tags are blanks."""
    return _TAG.sub(lambda m: " " * len(m.group()), text).translate(_BARE) if "<" in text else text.translate(_BARE)


def bare_offsets(text: str) -> np.ndarray:
    """For each character of :func:`bare`, the index of the character of ``text`` it comes from."""
    if "<" in text:
        text = _TAG.sub(lambda m: " " * len(m.group()), text)
    return np.repeat(np.arange(len(text)), [len(_BARE[ord(c)]) for c in text])


def marked(text: str) -> str:
    """Letters, digits and combining marks of the composed form, without case."""
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).translate(_MARKED))


def dense_script(text: str) -> bool:
    """Whether most letters are Han or kana, which say more per character."""
    if not text:
        return False
    dense = sum(1 for c in text if "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿")
    return 2 * dense > len(text)
