"""Lexicon of a bilingual table and the points where two texts match; used by problems 2, 3 and 4.

The lexicon is learned from all rows whose original and translation are one sentence each, where
no alignment is needed: for each source word and pair of words the target word pairs that come with it far
more often than chance (Dice coefficient). Words that both sides share, such as names and
numbers, are no entries: they match by themselves. Entries need a support of ``MIN_SHARE`` of
the pairs of sentences (and of three), which bounds their number.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .normalize import QUICK_CHECK, canonical

MIN_SHARE, MIN_COUNT, MIN_DICE = 2e-5, 3, 0.12
END = re.compile(r"[.!?…](?=\s|$)")
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_QUICK = re.compile(QUICK_CHECK)


def plain(text: str | None) -> str:
    """The text in its consistent form."""
    if not text:
        return ""
    return canonical(text, forms=False)[0] if _QUICK.search(text) else text


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences: one ends at a mark before white space or the text's end."""
    out, start = [], 0
    for m in END.finditer(text):
        a = start
        while a < m.end() and text[a].isspace():
            a += 1
        if a < m.start():
            out.append((a, m.end()))
        elif out:  # a second mark: it belongs to the sentence before
            out[-1] = (out[-1][0], m.end())
        start = m.end()
    rest = text[start:]
    if rest.strip():
        a = start + len(rest) - len(rest.lstrip())
        out.append((a, start + len(rest.rstrip())))
    return out


def words(text: str) -> list[str]:
    return WORD.findall(text)


def pairs(tokens: list[str]) -> list[str]:
    return [a + " " + b for a, b in zip(tokens, tokens[1:])]


@dataclass
class Lexicon:
    """entries: source word or pair of words -> {target word pair: Dice}; idf: source word -> weight; ratio: characters of a translation for one of its original."""

    entries: dict[str, dict[str, float]] = field(default_factory=dict)
    idf: dict[str, float] = field(default_factory=dict)
    syllables: frozenset[str] = frozenset()
    ratio: float = 1.0

    def weight(self, word: str) -> float:
        return self.idf.get(word, 0.0)


#: Names of the sums of lengths among the counts; no pair of words has one.
_SOURCE_LENGTH, _TARGET_LENGTH = "\x00source", "\x00target"


def _counts(rows: DataFrame) -> DataFrame:
    """(s, t, n): joint counts of source words and target pairs, and their own with a null on the other side."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        joint: Counter = Counter()
        for pdf in filter(len, it):
            for o, t in zip(pdf["o"], pdf["t"]):
                o, t = plain(o), plain(t)
                src, tgt = words(o), words(t)
                same = set(src) & set(tgt)
                ls = [None if w in same or w.isdigit() else w.lower() for w in src]
                s = {w for w in ls if w} | {a + " " + b for a, b in zip(ls, ls[1:]) if a and b}
                low = [None if w in same or w.isdigit() else w.lower() for w in tgt]
                p = {a + " " + b for a, b in zip(low, low[1:]) if a and b}
                if not p and len(low) == 1 and low[0]:
                    continue
                joint.update((a, b) for a in s for b in p)
                joint.update((a, "") for a in s)
                joint.update(("", b) for b in p)
                joint[("", "")] += 1
                joint[("", _SOURCE_LENGTH)] += len(o)
                joint[("", _TARGET_LENGTH)] += len(t)
            if len(joint) > 1_000_000:
                yield _frame(joint)
                joint = Counter()
        yield _frame(joint)

    def _frame(joint: Counter) -> pd.DataFrame:
        return pd.DataFrame([(a, b, n) for (a, b), n in joint.items()], columns=["s", "t", "n"])

    return rows.mapInPandas(run, "s string, t string, n long").groupBy("s", "t").agg(F.sum("n").alias("n"))


def learn(paragraphs: DataFrame) -> Lexicon:
    """The lexicon of all rows with one sentence on each side."""
    one = r"^[^.!?…]*[.!?…]?$"
    o, t = F.trim("original_text"), F.trim("translated_text")
    rows = paragraphs.filter(F.col("status").isin("done", "edited") & (F.col("translated_text") != F.col("original_text")))
    rows = rows.filter(o.rlike(one) & t.rlike(one)).select(o.alias("o"), t.alias("t"))
    counts = checkpointed(_counts(rows))
    sums = {r.t: r.n for r in counts.filter((F.col("s") == "") & F.col("t").isin("", _SOURCE_LENGTH, _TARGET_LENGTH)).collect()}
    n = sums.get("", 0)
    least = max(MIN_COUNT, math.ceil(n * MIN_SHARE))
    kept = counts.filter(F.col("n") >= least)
    joint = kept.filter("s != '' and t != ''")
    src = kept.filter("s != '' and t = ''").select("s", F.col("n").alias("ns"))
    tgt = kept.filter("s = '' and t != ''").select("t", F.col("n").alias("nt"))
    strong = joint.join(src, "s").join(tgt, "t").withColumn("dice", 2 * F.col("n") / (F.col("ns") + F.col("nt"))).filter(F.col("dice") >= MIN_DICE)
    lexicon = Lexicon(ratio=sums.get(_TARGET_LENGTH, 1) / max(1, sums.get(_SOURCE_LENGTH, 1)) or 1.0)
    for r in strong.select("s", "t", "dice").collect():
        lexicon.entries.setdefault(r.s, {})[r.t] = r.dice
    for r in src.collect():
        lexicon.idf[r.s] = math.log((n + 1) / r.ns)
    return trim_lexicon(lexicon)


def trim_lexicon(lexicon: Lexicon) -> Lexicon:
    """Keep pairs near a word's best; a pair of two target words that belongs to several source words stays with each."""
    for s, ts in lexicon.entries.items():
        top = max(ts.values())
        lexicon.entries[s] = {t: d for t, d in ts.items() if d >= 0.2 * top}
    lexicon.syllables = frozenset(x for ts in lexicon.entries.values() for t in ts for x in t.split())
    return lexicon


NAME, NUMBER, LEAST_POINT = 3.0, 3.0, 0.3


@dataclass
class Match:
    """Points of two texts: source token, target token, weight."""

    src: list[re.Match]
    tgt: list[re.Match]
    points: list[tuple[int, int, float]]
    src_weight: list[float]
    src_word: list[str]


def match(source: str, target: str, lexicon: Lexicon) -> Match:
    """All points between source and target tokens, and each source token's weight (0: no evidence)."""
    src, tgt = list(WORD.finditer(source)), list(WORD.finditer(target))
    at: dict[str, list[int]] = defaultdict(list)
    low = []
    for j, m in enumerate(tgt):
        at[m.group()].append(j)
        low.append(m.group().lower())
    pair_at: dict[str, list[int]] = defaultdict(list)
    for j in range(len(low) - 1):
        pair_at[low[j] + " " + low[j + 1]].append(j)
    points, weights, forms = [], [], []
    for i, m in enumerate(src):
        w = m.group()
        lw = w.lower()
        forms.append(lw)
        entry = lexicon.entries.get(lw)
        if w.isdigit():
            weights.append(NUMBER)
            points += [(i, j, NUMBER) for j in at.get(w, ())]
            continue
        shared = at.get(w) if w[0].isupper() else None
        if shared:
            weights.append(NAME)
            points += [(i, j, NAME) for j in shared]
            continue
        if entry:
            idf = lexicon.weight(lw)
            weight = min(max(idf, 1.5), 4.0) if idf >= 0.8 else idf
            weights.append(weight)
            top = max(entry.values())
            for t, d in entry.items():
                if d < 0.4 * top or weight * d < LEAST_POINT * top:
                    continue
                points += [(i, j, weight * d / top) for j in pair_at.get(t, ())]
        else:
            weights.append(NAME if w[0].isupper() and lw not in lexicon.idf else 0.0)
    return Match(src, tgt, points, weights, forms)
