"""Text predicates and rewrites as column expressions. All regular expressions are Unicode-aware."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Unicode white space, spelled for Java and RE2 alike.
BLANK = r"[\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_BLANK = "[^" + BLANK[1:]
TRIM = f"^{BLANK}+|{BLANK}+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, TRIM, "")


def squeeze(c: Column) -> Column:
    """White space runs to one space, none outside."""
    return F.trim(F.regexp_replace(c, f"{BLANK}+", " "))


def word_count(c: Column) -> Column:
    """Words separated by white space; 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(c, F.lit(f"({NOT_BLANK}+)"), F.lit(1))), F.lit(0)).cast("long")


def effective(translated: Column, original: Column) -> Column:
    """The translation where it says something, else the original."""
    t = strip(translated)
    return F.when(F.coalesce(F.length(t), F.lit(0)) > 0, t).otherwise(original)


@pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


#: Symbols of the Unicode fallback for LaTeX in their order of replacement; fixed values (the order decides).
UNICODE_SYMBOLS = (
    ("\\times", "×"), ("\\cdot", "·"), ("\\in", "∈"), ("\\notin", "∉"), ("\\subset", "⊂"), ("\\subseteq", "⊆"), ("\\cup", "∪"), ("\\cap", "∩"),
    ("\\forall", "∀"), ("\\exists", "∃"), ("\\rightarrow", "→"), ("\\to", "→"), ("\\leftarrow", "←"), ("\\Rightarrow", "⇒"), ("\\Leftarrow", "⇐"),
    ("\\leq", "≤"), ("\\le", "≤"), ("\\geq", "≥"), ("\\ge", "≥"), ("\\neq", "≠"), ("\\ne", "≠"), ("\\approx", "≈"), ("\\sim", "∼"), ("\\infty", "∞"), ("\\pm", "±"),
    ("\\alpha", "α"), ("\\beta", "β"), ("\\gamma", "γ"), ("\\delta", "δ"), ("\\epsilon", "ε"), ("\\theta", "θ"), ("\\lambda", "λ"), ("\\mu", "μ"), ("\\sigma", "σ"), ("\\tau", "τ"), ("\\phi", "φ"), ("\\omega", "ω"),
    ("\\Delta", "Δ"), ("\\Sigma", "Σ"), ("\\Omega", "Ω"), ("\\mathbb{R}", "ℝ"), ("\\mathbb{N}", "ℕ"), ("\\mathbb{Z}", "ℤ"), ("\\sum", "∑"), ("\\prod", "∏"), ("\\int", "∫"),
)
#: Symbols that word-processor text replaces; fixed values.
DOCX_SYMBOLS = tuple(p for p in UNICODE_SYMBOLS if p[0] in {
    "\\times", "\\cdot", "\\in", "\\notin", "\\leq", "\\geq", "\\neq", "\\approx", "\\infty", "\\pm", "\\alpha", "\\beta", "\\gamma", "\\delta", "\\epsilon", "\\theta",
    "\\lambda", "\\mu", "\\sigma", "\\tau", "\\phi", "\\omega", "\\Delta", "\\Sigma", "\\Omega", "\\mathbb{R}", "\\mathbb{N}", "\\mathbb{Z}", "\\sum", "\\prod", "\\int",
})
STRUCTURES = (("\\\\frac\\{([^}]+)\\}\\{([^}]+)\\}", "({1} / {2})"), ("\\\\sqrt\\{([^}]+)\\}", "√({1})"), ("\\\\text\\{([^}]+)\\}", "{1}"))
SCRIPTS = (("_\\{([^}]+)\\}", "<sub>{1}</sub>"), ("_([a-zA-Z0-9])", "<sub>{1}</sub>"), ("\\^\\{([^}]+)\\}", "<sup>{1}</sup>"), ("\\^([a-zA-Z0-9])", "<sup>{1}</sup>"))


def _rewrites(c: Column, rules) -> Column:
    return reduce(lambda x, r: F.regexp_replace(x, r[0], r[1].replace("{1}", "$1").replace("{2}", "$2")), rules, c)


def math_unicode(c: Column) -> Column:
    """LaTeX to HTML text: ordered literal replacements, then fractions, roots, text, subscripts and superscripts."""
    c = reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), UNICODE_SYMBOLS, c)
    return F.concat(F.lit('<span class="math-fallback">'), _rewrites(c, STRUCTURES + SCRIPTS), F.lit("</span>"))


#: Formulas between dollar signs: a block, or inline; fixed value.
FORMULA = r"\$\$[^$]+\$\$|\$[^$\n]+\$"


def formula_name(c: Column) -> Column:
    return F.concat(F.lit("math_"), F.substring(F.md5(F.concat(c, F.lit("_250"))), 1, 12))


def math_epub(c: Column) -> Column:
    """The text with each formula as the image that an EPUB holds of it, named by its content; the formula is its other text."""
    formulas = F.array_distinct(F.regexp_extract_all(c, F.lit(f"({FORMULA})"), F.lit(1)))

    def image(f: Column) -> Column:
        inner = F.trim(F.regexp_replace(f, r"^\$+|\$+$", ""))
        kind = F.when(f.startswith("$$"), "block").otherwise("inline")
        return F.concat(F.lit('<img class="math-'), kind, F.lit('" src="images/'), formula_name(inner), F.lit('.png" alt="'), html_escape(inner), F.lit('"/>'))

    return F.aggregate(F.array_sort(formulas, lambda a, b: F.length(b) - F.length(a)), c, lambda acc, f: F.replace(acc, f, image(f)))


def math_docx(c: Column) -> Column:
    """LaTeX to plain text: structures first, then symbols, then dollar signs away."""
    c = _rewrites(F.replace(c, F.lit("\\$"), F.lit("$")), STRUCTURES)
    c = reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), DOCX_SYMBOLS, c)
    return F.regexp_replace(c, "\\$([^\\$]+)\\$", "$1")


#: Patterns of captions; fixed values.
CAPTION = r"^(?:Figure|Fig\.?|Hình|Table|Bảng)[ \t]*[\d.\-]+[:.\-–]"
CAPTION_LABEL = r"^((?:Figure|Fig\.?|Hình|Table|Bảng)[ \t]*[\d.\-]+[:.\-–])[ \t]*(.*)$"


def is_caption(tag: Column, original: Column, translated: Column) -> Column:
    def like(c: Column) -> Column:
        return F.coalesce(strip(c).rlike("(?iu)" + CAPTION), F.lit(False))

    return F.coalesce(tag == "caption", F.lit(False)) | like(original) | like(translated)


def is_table_caption(para_id: Column, original: Column, translated: Column) -> Column:
    def like(c: Column) -> Column:
        return F.coalesce(strip(c).rlike(r"(?iu)^(?:Table|Bảng)"), F.lit(False))

    return like(original) | like(translated) | F.coalesce(F.contains(F.lower(para_id), F.lit("tab")), F.lit(False))


def is_footnote(c: Column) -> Column:
    return F.coalesce(strip(c).rlike("^[∗†‡*]"), F.lit(False))


#: Section names that are headings by themselves; fixed values.
SECTION_NAMES = (
    "abstract", "introduction", "background", "related work", "related works", "methodology", "methods", "method", "materials and methods", "experimental setup",
    "experiments", "experiment", "results", "results and discussion", "discussion", "analysis", "evaluation", "conclusion", "conclusions", "summary", "future work",
    "future directions", "limitations", "acknowledgements", "acknowledgments", "acknowledgement", "acknowledgment", "references", "bibliography", "appendix",
    "supplementary material", "supplementary materials", "data availability", "competing interests", "author contributions", "funding", "ethics statement", "declarations",
)

#: Patterns of headings; fixed values.
_TAIL = r"[A-Z][\p{L}\p{N}_\s\-/,()&:]{1,90}"
SUBSECTION = rf"^((?:\d+\.)+\d+)\.?\s+({_TAIL})$"
NUMBERED = rf"^(\d{{1,3}})\.?\s+({_TAIL})$"
ROMAN = rf"^([IVXLC]{{1,6}})\.?\s+({_TAIL})$"
CHAPTER = r"^(?:Chapter|Part|Section)\s+(\d+|[IVXLC]+)[:\s.\-]*(.*)$"
TOC_LINE = r"\.{3,}\s*\d+\s*$|\s{2,}\d{1,4}\s*$"
LIST_SENTENCE = r"^\d{1,3}\.\s+[A-Z].*[.!?;:]\s*$"
LEADING_NUMBER = r"^[\d.]+\s*"


def match_key(c: Column) -> Column:
    """Text for matching: white space squeezed, lower case, no leading digits and dots."""
    return F.trim(F.regexp_replace(F.lower(squeeze(c)), LEADING_NUMBER, ""))


def looks_like_prose(c: Column) -> Column:
    t = F.trim(c)
    return (F.length(t) > 120) | t.rlike(r"[.,;!?]$")


def is_section_name(c: Column) -> Column:
    k = match_key(c)
    return k.isin(*SECTION_NAMES) | k.rlike(r"^appendix\s+[a-z0-9]")


def heading_level(c: Column) -> Column:
    """1 (major), 2 (subsection) or null by the text alone: the first rule that fits decides."""
    t = F.trim(c)
    n = F.length(t)
    prose = looks_like_prose(t)

    def rest(pattern: str) -> Column:
        return F.trim(F.regexp_extract(t, pattern, 2))

    none = F.lit(None).cast("int")
    return (
        F.when((n < 2) | t.isNull(), none)
        .when(t.rlike(TOC_LINE), none)
        .when(n > 90, none)
        .when(t.rlike(LIST_SENTENCE) & (n > 60), none)
        .when(t.rlike(SUBSECTION) & ~prose & (n < 80) & (F.length(rest(SUBSECTION)) < 70) & ~rest(SUBSECTION).rlike(r"[.,;!?]$"), F.lit(2))
        .when(is_section_name(t) & ~prose, F.lit(1))
        .when(t.rlike("(?i)" + CHAPTER), F.lit(1))
        .when(t.rlike(NUMBERED) & ~prose & (F.length(rest(NUMBERED)) < 70) & ~rest(NUMBERED).rlike(r"[.,;!?]$"), F.lit(1))
        .when(t.rlike(ROMAN) & ~prose & (n < 80), F.lit(1))
        .otherwise(none)
    )


#: Marks of a scene break; fixed values.
SCENE_MARKERS = ("* * *", "***", "• • •", "---", "—", "⁂", "* * * *", "~ ~ ~", "~~~", "- - -", "•   •   •", "♦", "§", "# # #")
ORNAMENTS = "^[·*•—–\\-~#§♦⁂ \\t]+$"


def is_scene_break(tag: Column, text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.coalesce(tag == "hr", F.lit(False)) | t.isin(*SCENE_MARKERS) | t.rlike(ORNAMENTS)


def output_tag(tag: Column) -> Column:
    return F.when(F.lower(tag).isin("h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "li"), F.lower(tag)).otherwise("p")


def clean_file_name(name: Column) -> Column:
    """A title from a file name: no extension, no prefix of eight hex digits, underscores as spaces."""
    base = F.regexp_replace(name, r"\.[A-Za-z0-9]+$", "")
    return F.trim(F.replace(F.regexp_replace(base, "^[0-9a-f]{8}_", ""), F.lit("_"), F.lit(" ")))


def safe_file_name(title: Column) -> Column:
    return F.trim(F.regexp_replace(title, r"[^\p{L}\p{N} _\-]", ""))


#: Patterns of chapter lines of plain text and of word-processor paragraphs; fixed values.
TXT_CHAPTER = r"^(?:(?:chapter|chương|part|phần|hồi)\s+(?:[0-9ivxlcdm]+|[a-z]+)(?:[\s:.–—-].*)?|(?:prologue|epilogue|interlude|lời mở đầu|lời kết)(?:[\s:.–—-].*)?)$"
DOCX_CHAPTER = r"^(?:(?:chapter|chương|part|phần|hồi)\s+(?:\d+|[ivxlcdm]+|one|two|three|four|five|six|seven|eight|nine|ten)(?:\s*[:.–—-]\s*.+)?|prologue|epilogue|interlude|lời mở đầu|lời kết)$"


def is_chapter_line(c: Column, strict: bool) -> Column:
    """A chapter line of plain text: under 100 characters; the strict form wants a number after the word."""
    t = F.trim(c)
    return (F.length(t) < 100) & t.rlike("(?iu)" + (DOCX_CHAPTER if strict else TXT_CHAPTER))
