"""Formulas in running text to HTML: display blocks, numbered equations, inline formulas; amounts of money stay."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from .text import SCRIPTS, STRUCTURES, UNICODE_SYMBOLS

_DISPLAY = re.compile(r"\$\$(.+?)\$\$", re.S)
_INLINE = re.compile(r"(?<!\\)\$([^$\n]+?)(?<!\\)\$")
_TAG = re.compile(r"\\tag\{([^}]*)\}")
_MONEY = re.compile(r"^\s*[\d.,]+\s*$")
_BARE = re.compile(r"\\frac\{[^}]+\}\{[^}]+\}")


def unicode_formula(latex: str) -> str:
    text = reduce(lambda x, r: x.replace(*r), UNICODE_SYMBOLS, latex)
    rules = [(p, r.replace("{1}", r"\1").replace("{2}", r"\2")) for p, r in STRUCTURES + SCRIPTS]
    return reduce(lambda x, r: re.sub(r[0], r[1], x), rules, text)


def format_math(text: str | None) -> str | None:
    """None stays None. A tag becomes the equation's number; a bare fraction outside dollars is a formula too."""
    if text is None:
        return None
    kept: list[str] = []

    def keep(html: str) -> str:
        kept.append(html)
        return f"\x00{len(kept) - 1}\x00"

    def display(m: re.Match) -> str:
        body = m.group(1)
        tag = _TAG.search(body)
        number = f'<span class="number">({tag.group(1)})</span>' if tag else ""
        return keep(f'<div class="equation">{unicode_formula(_TAG.sub("", body).strip())}{number}</div>')

    out = _DISPLAY.sub(display, text)
    out = _INLINE.sub(lambda m: m.group() if _MONEY.match(m.group(1)) else keep(f'<span class="formula">{unicode_formula(m.group(1))}</span>'), out)
    out = _BARE.sub(lambda m: keep(f'<span class="formula">{unicode_formula(m.group())}</span>'), out)
    return re.sub("\x00(\\d+)\x00", lambda m: kept[int(m.group(1))], out)


@pandas_udf(StringType())
def math_html(texts: pd.Series) -> pd.Series:
    return texts.map(format_math)
