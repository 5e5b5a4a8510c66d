"""Scalar derivations as Spark columns (projections of the canonical contract)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The category taxonomy, in order.
TAXONOMY = (
    "Violence", "Sexual", "Criminal Planning/Confessions", "Guns and Illegal Weapons", "Controlled/Regulated Substances", "Suicide and Self Harm",
    "Sexual (minor)", "Hate/Identity Hate", "PII/Privacy", "Harassment", "Threat", "Profanity", "Needs Caution", "Other", "Manipulation", "Fraud/Deception",
    "Malware", "High Risk Gov Decision Making", "Political/Misinformation/Conspiracy", "Copyright/Trademark/Plagiarism", "Unauthorized Advice",
    "Illegal Activity", "Immoral/Unethical",
)
#: Label domain, prepared languages, the label words of the SEA benchmark, and language directories.
LABELS = ("safe", "unsafe")
LANGUAGES = ("en", "ar", "de", "es", "fr", "hi", "ja", "th", "zh")
SEA_LABELS = {"safe": "safe", "an toàn": "safe", "harmful": "unsafe", "có hại": "unsafe"}
LANGUAGE_DIRECTORIES = {"en": "en", "ar": "ar", "de": "de", "es": "sp", "fr": "fr", "hi": "hi", "ja": "ja", "zh": "zh"}
_BLANK = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    """Without Unicode white space at the ends; the built-in trim removes only U+0020."""
    return F.regexp_replace(c, _BLANK, "")


def truthy(c: Column) -> Column:
    """Whether a text is neither null nor empty."""
    return F.coalesce(c != "", F.lit(False))


def clean_nan(c: Column) -> Column:
    """NaN becomes null."""
    return F.when(~F.isnan(c), c)


def digest(c: Column) -> Column:
    """SHA-256 of the text, in hex."""
    return F.sha2(c, 256)


def alias_language(language: Column, path: Column) -> Column:
    """Spellings of ``zh`` become one; a missing language is the name of the file's directory."""
    raw = F.when(truthy(language), language).otherwise(F.element_at(F.split(path, "/"), -2))
    return F.when(raw.isin("zh-CN", "zh_CN", "zh-cn"), "zh").otherwise(raw)


def lower_label(c: Column) -> Column:
    """Lower case without a trim: a label with outer blanks is no label."""
    return F.lower(F.coalesce(c, F.lit("")))


def sea_label(c: Column) -> Column:
    """Label words of the SEA benchmark; anything else raises."""
    plain = F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("")))), r"(?U)\s+", " ")
    known = F.create_map(*[F.lit(x) for pair in SEA_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, plain), F.raise_error(F.concat(F.lit("unsupported label: "), F.coalesce(c, F.lit("null")))))


def naive_categories(c: Column) -> Column:
    """Split at commas, stripped, empties dropped; null gives an empty array."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), strip), lambda x: x != "")


def source_id(id_: Column, path: Column, line: Column) -> Column:
    """The id if there is one, else the digest of ``path:line``."""
    return F.when(truthy(id_), id_).otherwise(digest(F.concat_ws(":", path, line.cast("string"))))


def csv_source_id(language: Column, file_name: Column, record: Column, prompt: Column) -> Column:
    """First 20 hex digits of the digest of ``language:file:record:prompt``."""
    return F.substring(digest(F.concat_ws(":", language, file_name, record.cast("string"), prompt)), 1, 20)


def category_of_file(file_name: Column) -> Column:
    """The file's stem."""
    return F.regexp_replace(file_name, r"\.csv$", "")


def padded_line(line: Column) -> Column:
    """At least four digits; longer numbers stay whole."""
    return F.format_string("%04d", line)


def relative_path(path: Column, root: str) -> Column:
    """The path below ``root``."""
    return F.regexp_replace(path, "^(?:file:)?/*" + root.strip("/").replace(".", r"\.") + "/", "")


def text_of(prompt: Column, response: Column) -> Column:
    """The joint text of a prompt and, unless null, a response."""
    return F.concat(F.lit("Prompt: "), prompt, F.coalesce(F.concat(F.lit("\nResponse: "), response), F.lit("")))


def split_text(text: Column) -> tuple[Column, Column]:
    """(prompt, response) of a joint text: null response without the marker, empty with nothing behind it."""
    at = F.instr(text, "\nResponse:")
    first = F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)
    prompt = F.regexp_replace(F.regexp_replace(first, "^Prompt:", ""), r"(?U)^\s+", "")
    response = F.when(at > 0, F.regexp_replace(F.substring(text, at + F.lit(len("\nResponse:")), F.length(text)), r"(?U)^\s+", ""))
    return prompt, response


def subset_or_all(c: Column) -> Column:
    """``ALL`` where the subset is null or empty."""
    return F.when(truthy(c), c).otherwise("ALL")


def is_unsafe(c: Column) -> Column:
    """1 for ``unsafe``, 0 for anything else, null included."""
    return F.coalesce(c == "unsafe", F.lit(False)).cast("int")


def utf8_bytes(c: Column) -> Column:
    """Length in bytes."""
    return F.octet_length(c)


def utc_stamp(c: Column) -> Column:
    """``yyyyMMddTHHmmssZ`` of a timestamp."""
    return F.date_format(c, "yyyyMMdd'T'HHmmss'Z'")


def taxonomy_text() -> Column:
    """``S1: name.`` lines."""
    return F.array_join(F.transform(F.array(*map(F.lit, TAXONOMY)), lambda x, i: F.concat(F.lit("S"), (i + 1).cast("string"), F.lit(": "), x, F.lit("."))), "\n")


def _json_text(c: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))


def target_json(view: Column, label: Column, prompt_label: Column, categories: Column) -> Column:
    """The training target: labels, and known categories in taxonomy order, with ``", "`` and ``": "`` as separators."""
    known = F.filter(F.array(*map(F.lit, TAXONOMY)), lambda x: F.array_contains(F.coalesce(categories, F.array().cast("array<string>")), x))
    parts = F.array(
        F.concat(F.lit('"User Safety": '), _json_text(prompt_label)),
        F.when(view == "PR", F.concat(F.lit('"Response Safety": '), _json_text(label))),
        F.when(F.size(known) > 0, F.concat(F.lit('"Safety Categories": "'), F.array_join(known, ", "), F.lit('"'))),
    )
    return F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}"))


def target_binary(label: Column) -> Column:
    """``Safety: Unsafe`` or ``Safety: Safe``."""
    return F.concat(F.lit("Safety: "), F.when(label == "unsafe", "Unsafe").otherwise("Safe"))


def head_tail(tokens: Column, budget: Column | int) -> Column:
    """The first half and the last rest of an array that exceeds the budget; a budget of 0 keeps the whole tail."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    head = F.floor(budget / 2).cast("int")
    tail = (budget - head).cast("int")
    whole = F.size(tokens)
    short = F.concat(F.slice(tokens, F.lit(1), head), F.when(tail > 0, F.slice(tokens, whole - tail + 1, tail)).otherwise(tokens))
    return F.when(whole > budget, short).otherwise(tokens)


def completion_labels(prompt: Column, target: Column) -> Column:
    """-100 for each prompt token, then the target."""
    return F.concat(F.array_repeat(F.lit(-100), F.size(prompt)), target)


def guard_prompt(prompt: Column, response: Column, template: str) -> Column:
    """Fills ``{taxonomy}``, ``{query}`` and ``{response_block}`` of a template; the chat format belongs to the scorer."""
    block = F.coalesce(F.concat(F.lit("response: agent: "), response, F.lit("\n")), F.lit(""))
    out = F.lit("")
    rest = template
    slots = {"{taxonomy}": taxonomy_text(), "{query}": prompt, "{response_block}": block}
    while rest:
        at = min((rest.find(s) for s in slots if s in rest), default=-1)
        if at < 0:
            return F.concat(out, F.lit(rest))
        slot = next(s for s in slots if rest.startswith(s, at))
        out = F.concat(out, F.lit(rest[:at]), slots[slot])
        rest = rest[at + len(slot) :]
    return out
