"""One consistent form for text whose characters differ but look alike (problem 6).

A quick check in the JVM isolates values that hold a character which is unstable under the
canonical form: most values never reach Python. In an unstable value only the segments around
such characters (with their boundary context: the base letter before a combining accent, the
word around a look-alike) are normalized and spliced into the unchanged rest.

The quick check is made of properties: NFC quick check is No, combining, width variants, ligatures.
Canonical form: full-width Latin letters and digits become ASCII; combining accents are composed
(NFC) with the letter before them; zero-width characters go; non-breaking spaces become a
space; zero-width joiners stay between pictures and letters of scripts that join; what else has another form by its properties (full-width marks, ligatures, Hangul in parts,
singletons) takes it, as the kind other_form, which is no disguise; look-alike letters inside a Latin word become the Latin letter. Whole words and single
symbols of other alphabets stay. A null or an empty text stays as it is and has no kinds.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of no width, spaces that do not break, and letters of Greek and
#: Cyrillic that look like a Latin one (Unicode confusables, one letter each).
ZERO_WIDTH = "\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufeff"
NO_BREAK = "\u00a0\u2007\u202f"
LOOK_ALIKE = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Һ": "H", "Ё": "Ë", "Ї": "Ï",
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ү": "y", "ԛ": "q", "ԝ": "w", "һ": "h", "ԁ": "d", "ё": "ë", "ї": "ï", "ѵ": "v",
    "ɑ": "a", "ɡ": "g",
}

_ALIKE = "".join(LOOK_ALIKE)
#: Letters of Greek and Cyrillic with an accent, composed: ὸ, ά ...; they decompose to a look-alike and an accent.
_OTHER = "\u0370-\u03ff\u0400-\u052f\u1f00-\u1fff"
_FULL = "０-９Ａ-Ｚａ-ｚ"
#: The blocks of combining accents.
_MARK = "\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f"
#: Letters of Hangul in parts, which compose.
_JAMO = "\u1100-\u11ff"


def _ranges(points: list[int]) -> str:
    """A character class of code points in order."""
    out: list[list[int]] = []
    for p in points:
        if out and p == out[-1][1] + 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(rf"\u{a:04x}-\u{b:04x}" if a != b else rf"\u{a:04x}" for a, b in out)


def _form(p: int) -> bool:
    """Whether a character has another form by its Unicode properties: NFC quick check is No, or it is a width variant or a ligature."""
    c = chr(p)
    return not unicodedata.is_normalized("NFC", c) or unicodedata.decomposition(c).startswith(("<wide>", "<narrow>")) or 0xFB00 <= p <= 0xFB06


#: Characters of the basic plane with another form, by their properties.
_FORMS = _ranges([p for p in range(0x80, 0x10000) if not 0xD800 <= p <= 0xDFFF and _form(p)])
_ODD = re.compile(f"[{_OTHER}{_MARK}{_JAMO}{ZERO_WIDTH}{NO_BREAK}{_FORMS}{_ALIKE}]")
#: The quick check: any character outside the blocks of most texts, less what is not stable there. Few ranges, so it is fast in the JVM.
_BLOCKS = ((0x00, 0x2FF), (0x1E00, 0x1EFF), (0x2010, 0x2027), (0x2030, 0x205E), (0x3001, 0x9FFF), (0xAC00, 0xD7A3))
QUICK_CHECK = f"[^{_ranges([p for a, b in _BLOCKS for p in range(a, b + 1) if not _ODD.match(chr(p))])}]"

#: The kinds of disguise that a reader cannot see; other forms are brought together, too, but are no disguise.
DISGUISES = ("combining", "full_width", "look_alike", "no_break_space", "zero_width")
_JOINERS = "\u200c\u200d"
_HARD = re.compile(f"[{_FULL}]+|[{ZERO_WIDTH}]+|[{NO_BREAK}]+")
_ACCENTED = re.compile(f"[^\\W\\d_][{_MARK}]+")
_WORD = re.compile(f"[^\\W\\d_{_MARK}]+(?:[{_MARK}]+[^\\W\\d_{_MARK}]*)*")
_UNSTABLE = re.compile(f"[{_OTHER}ɑɡ]")
_LATIN = re.compile("[A-Za-z\u00c0-\u024f\u1e00-\u1eff]")
_SEGMENT = re.compile(f"[{_JAMO}]+|[{_FORMS}]")


def _needed(text: str, start: int, end: int) -> bool:
    """Whether a joiner stands between characters that it shapes: pictures, or letters of a script that joins."""
    before, after = text[start - 1 : start], text[end : end + 1]
    return bool(before and after) and all(unicodedata.category(c) in ("Lo", "Mn", "Mc", "So", "Sk") for c in (before, after))


def _latin_twin(ch: str) -> str | None:
    """The Latin letter that a character of another alphabet looks like, with its accents."""
    if ch in LOOK_ALIKE:
        return LOOK_ALIKE[ch]
    base, *marks = unicodedata.normalize("NFD", ch)
    if marks and base in LOOK_ALIKE:
        return unicodedata.normalize("NFC", LOOK_ALIKE[base] + "".join(marks))
    return None


def _unmix(word: re.Match) -> str:
    """A word of Latin letters and look-alikes, in Latin; any other word as it is."""
    text = word.group()
    if not _UNSTABLE.search(text) or not _LATIN.search(text):
        return text
    out = []
    for ch in text:
        if _UNSTABLE.match(ch):
            twin = _latin_twin(ch)
            if twin is None:
                return text
            out.append(twin)
        else:
            out.append(ch)
    return "".join(out)


def canonical(text: str, forms: bool = True) -> tuple[str, list[str]]:
    """The consistent form of a text and the kinds of disguise it held, sorted.

    With ``forms``, what has another form by its properties is brought to it as well.
    """
    kinds = set()

    def plain(m: re.Match) -> str:
        s = m.group()
        if s[0] in ZERO_WIDTH:
            if all(c in _JOINERS for c in s) and _needed(text, m.start(), m.end()):
                return s
            kinds.add("zero_width")
            return ""
        if s[0] in NO_BREAK:
            kinds.add("no_break_space")
            return " " * len(s)
        kinds.add("full_width")
        return unicodedata.normalize("NFKC", s)

    out = _HARD.sub(plain, text)

    def composed(m: re.Match) -> str:
        kinds.add("combining")
        return unicodedata.normalize("NFC", m.group())

    out = _ACCENTED.sub(composed, out)
    if _UNSTABLE.search(out):
        latin = _WORD.sub(_unmix, out)
        if latin != out:
            kinds.add("look_alike")
            out = latin
    if forms and _SEGMENT.search(out):
        # Width variants and ligatures are stable under NFC; they take their compatible form.
        other = _SEGMENT.sub(lambda m: unicodedata.normalize("NFKC" if _form_of_width(m.group()) else "NFC", m.group()), out)
        if other != out:
            kinds.add("other_form")
            out = other
    return out, sorted(kinds)


def _form_of_width(s: str) -> bool:
    return unicodedata.is_normalized("NFC", s)


def normalize_values(df: DataFrame, record_kind: str, id_col: str, fields: list[str]) -> DataFrame:
    """(record_kind, record_id, field_name, changed, kinds, canonical) of each value of the fields.

    One row for each row and field. Stable values stay in the JVM; unstable ones go through Python.
    """
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value")) for f in fields]))
    values = df.select(F.lit(record_kind).alias("record_kind"), F.col(id_col).cast("long").alias("record_id"), each.alias("v")).select("record_kind", "record_id", "v.field_name", "v.value")
    unstable = F.coalesce(F.col("value").rlike(QUICK_CHECK), F.lit(False))
    stable = values.filter(~unstable).select("record_kind", "record_id", "field_name", F.lit(False).alias("changed"), F.array().cast("array<string>").alias("kinds"), F.col("value").alias("canonical"))
    return stable.unionByName(_normalized(values.filter(unstable)))


def _normalized(values: DataFrame) -> DataFrame:
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            done = [canonical(t) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array([bool(k) for _, k in done], pa.bool_()), pa.array([k for _, k in done], pa.list_(pa.string())), pa.array([t for t, _ in done], pa.string())],
                ["record_kind", "record_id", "field_name", "changed", "kinds", "canonical"],
            )

    return values.mapInArrow(batches, "record_kind string, record_id long, field_name string, changed boolean, kinds array<string>, canonical string")


def disguised_values(df: DataFrame, record_kind: str, id_col: str, fields: list[str]) -> DataFrame:
    """Only the values that hold a disguise: the quick check is pushed before Python."""
    any_unstable = reduce(lambda a, b: a | b, [F.coalesce(F.col(f).cast("string").rlike(QUICK_CHECK), F.lit(False)) for f in fields])
    return normalize_values(df.filter(any_unstable), record_kind, id_col, fields).filter(F.arrays_overlap("kinds", F.array(*[F.lit(k) for k in DISGUISES])))
