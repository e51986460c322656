"""Repairing text from scanned pages (problem 7).

A page's lines are taken apart into running header, page number and body. The body's characters
are decoded as one de-lined stream: a Viterbi search over its raw tokens may keep a token, undo a
confusion of characters in it, join it with the next across a line end, a hyphen or a blank, or
split it in two, each at a cost, against the word counts of the corpus. Spans whose tokens are all
known words are their own best reading and skip the search. Paragraph ends are chosen by dynamic
programming over the lines' slack and last marks.

Word counts come from every original_text outside scanned books; where there is none, from all
rows, less the words that are a confusion of one twenty times as frequent. Only words of at
least ``MIN_SHARE`` of all tokens (and three occurrences) are sent out: at most 1 / MIN_SHARE.

Defined results: a null or blank text gives no noise and no paragraphs; repeated deliveries are
pages of their own; a page whose next page is missing is decoded alone; a book without titles
has only headers that repeat at the top of its pages.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .normalize import canonical

MIN_COUNT, MIN_SHARE = 3, 2e-7
HYPHENS = "-¬‐"

#: Misread characters and what they stand for; fixed values.
CONFUSIONS = (
    ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("6", "b"), ("8", "b"), ("9", "g"), ("7", "t"), ("!", "i"), ("!", "l"),
    ("c", "e"), ("e", "c"), ("q", "g"), ("f", "t"), ("t", "f"), ("h", "b"), ("l", "i"), ("i", "l"),
    ("ii", "u"), ("vv", "w"), ("rn", "m"), ("m", "rn"), ("ri", "n"), ("n", "ri"), ("cl", "d"), ("d", "cl"), ("li", "h"), ("h", "li"),
)

_TOKEN = re.compile(r"!?[^\W_]+(?:[!'’][^\W_]+)*")
_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_LETTER = re.compile(r"[^\W\d_]")
_ROMAN = r"[ivxlcdm]{1,7}|[IVXLCDM]{1,7}"
_NUM = rf"(\d{{1,4}}|{_ROMAN})"
_STRONG = re.compile(rf"^\s*(?:\[\s*{_NUM}\s*\]|\(\s*{_NUM}\s*\)|{_NUM}\s*\||\|\s*{_NUM}|[-–—]\s*{_NUM}\s*[-–—]|(?:[Pp]age|[Pp]p?\.|PAGE|[Ss]eite|[Tt]rang)\s*{_NUM})\s*$")
_BARE = re.compile(rf"^\s*{_NUM}\s*$")
_BEFORE = re.compile(rf"^\s*{_NUM}(?:\s{{2,}}|\t|\s*\|\s*)(?=\S)")
_AFTER = re.compile(rf"(?:\s{{2,}}|\t|\s*\|\s*){_NUM}\s*$")
_TAIL = re.compile(rf"([^\W_]+)[{HYPHENS}]\s*(?:\n[^\n]{{0,14}}\d[^\n]{{0,3}}|\n\W*(?:{_ROMAN})\W*)?\s*$")
_TITLE_PAGE = re.compile(r"(?:\s*\t\s*|\s*(?:\.\s?){3,}\s*|\s{3,}|\s*…+\s*)(\d{1,4})\s*$")
_PREFIX = re.compile(r"^(?:[^\W\d_]+\s+)?\d{1,4}\s*[.:–—-]\s*")


def variants(word: str) -> set[str]:
    """The words that one undone confusion makes of a word."""
    out = set()
    for wrong, right in CONFUSIONS:
        at = word.find(wrong)
        while at >= 0:
            out.add(word[:at] + right + word[at + len(wrong) :])
            at = word.find(wrong, at + 1)
    return out


class Words:
    """Word counts with the best reading of a token."""

    def __init__(self, counts: dict[str, int]):
        self.counts, self.total = counts, max(1, sum(counts.values()))
        self.cache: dict[str, tuple[float, str, int]] = {}
        self.openers = {w.partition("-")[0] for w in counts if "-" in w}

    def known(self, token: str) -> bool:
        return token.lower() in self.counts

    def cost(self, word: str) -> float:
        return -math.log(self.counts[word] / self.total)

    def read(self, token: str) -> tuple[float, str, int]:
        """(cost, word, confusions) of the cheapest reading; an unknown word keeps its form."""
        low = token.lower()
        if low in self.cache:
            return self.cache[low]
        best = (self.cost(low), low, 0) if low in self.counts else (24.0 + 2 * len(low), low, 0)
        if low not in self.counts and len(low) > 1:
            once = variants(low)
            for w in once:
                if len(w) > 1 and w in self.counts:
                    best = min(best, (self.cost(w) + 6, w, 1))
            if best[2] == 0 and len(low) > 3:
                for v in once:
                    for w in variants(v):
                        if len(w) > 2 and w in self.counts:
                            best = min(best, (self.cost(w) + 12, w, 2))
        if len(self.cache) > 200_000:
            self.cache.clear()
        self.cache[low] = best
        return best


def _like(word: str, token: str) -> str:
    """The word in the token's case; a 7 stands for a capital T."""
    letters = [c for c in token if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return word.upper()
    return word[:1].upper() + word[1:] if token[:1].isupper() or token[:1] == "7" else word


MERGE, SPLIT, HANGING = 5.0, 9.0, 9.0


def _best_path(tokens: list[str], gaps: list[str], words: Words) -> list[tuple[int, int, str, tuple[str, ...]]]:
    """The cheapest reading of a span: (from token, to token, text, kinds of noise) of its edges.

    gaps[i] stands between tokens i and i + 1.
    """
    n = len(tokens)
    best: list[tuple[float, int, str, tuple[str, ...]]] = [(0.0, 0, "", ())] + [(math.inf, 0, "", ())] * n

    def edge(i: int, j: int, cost: float, text: str, kinds: tuple[str, ...]) -> None:
        if best[i][0] + cost < best[j][0]:
            best[j] = (best[i][0] + cost, i, text, kinds)

    def reading(raw: str, token: str) -> tuple[float, str, tuple[str, ...]]:
        cost, word, wrong = words.read(raw)
        return cost, (_like(word, token) if wrong else raw), (("ocr_char",) if wrong else ())

    for i in range(n):
        a = tokens[i]
        if not _LETTER.search(a):
            edge(i, i + 1, 1.0, a, ())
        else:
            cost, text, kinds = reading(a, a)
            hangs = i + 1 < n and _divides(gaps[i])
            edge(i, i + 1, cost + (HANGING if hangs else 0.0), text, kinds)
            low = a.lower()
            if not words.known(a) and not kinds and len(low) > 5:
                for at in range(2, len(low) - 1):
                    x, y = low[:at], low[at:]
                    if words.counts.get(x, 0) > 1e-5 * words.total and words.counts.get(y, 0) > 1e-5 * words.total:
                        edge(i, i + 1, words.cost(x) + words.cost(y) + SPLIT, a[:at] + " " + a[at:], ())
        for k, j in ((1, i + 2), (2, i + 3)):
            if j > n:
                break
            inner, last = gaps[i : j - 2], gaps[j - 2]
            if k == 2 and inner[0] != "-":
                break
            head, tail = "-".join(tokens[i : j - 1]), tokens[j - 1]
            if _divides(last):
                cost, text, kinds = reading(head + tail, head)
                edge(i, j, cost, text, (*kinds, "hyphen"))
                cost, text, kinds = reading(head + "-" + tail, head)
                edge(i, j, cost, text, kinds)
            elif last == "-" and k == 1:
                cost, text, kinds = reading(head + "-" + tail, head)
                edge(i, j, cost, text, kinds)
            elif last in (" ", "\n") and k == 1:
                cost, text, kinds = reading(head + tail, head)
                edge(i, j, cost + MERGE, text, kinds)
    out, j = [], n
    while j:
        _, i, text, kinds = best[j]
        out.append((i, j, text, kinds))
        j = i
    return out[::-1]


def _divides(gap: str) -> bool:
    """A hyphen at a present or former line end."""
    return gap[:1] != "" and gap[0] in HYPHENS and gap[1:2] in ("\n", " ") and not gap[1:].strip()


def decode(body: str, words: Words, following: str = "", before: str = "") -> tuple[str, set[str]]:
    """The continuous text of a page's body and its kinds of noise (hyphen, ocr_char).

    ``following`` is the first token of the next page, to tell whether a hyphen at the end of
    this one belongs to the word; ``before`` is the part of a word that the page before ends with.
    """
    kinds: set[str] = set()
    end = re.search(rf"([^\W_]+)[{HYPHENS}]\s*$", body)
    part = end.group(1) if end and _LETTER.search(end.group(1)) else ""
    marks = list(_TOKEN.finditer(body))
    tokens = [m.group() for m in marks]
    gaps = [body[a.end() : b.start()] for a, b in zip(marks, marks[1:])]
    inner = range(1 if before and body[:1].isalnum() else 0, len(tokens) - (1 if part else 0))
    odd = [i for i in inner if (i < len(gaps) and _divides(gaps[i])) or (_LETTER.search(tokens[i]) and not words.known(tokens[i]))]
    out, done, at = [], 0, 0
    while at < len(odd):
        lo = hi = odd[at]
        while at < len(odd) and odd[at] <= hi + 2:
            hi = odd[at]
            at += 1
        lo, hi = max(lo - 1, inner.start), min(hi + 2, max(inner.stop, hi + 1))
        while lo and gaps[lo - 1] == "-":
            lo -= 1
        if out and marks[lo].start() < done:  # spans touch: the last edge stays
            lo = next((k for k in range(lo, hi) if marks[k].start() >= done), hi)
        for i, j, text, found in _best_path(tokens[lo:hi], gaps[lo : hi - 1], words):
            kinds.update(found)
            a, b = marks[lo + i].start(), marks[lo + j - 1].end()
            if body[a:b] != text:
                out.append(body[done:a] + text)
                done = b
    out.append(body[done:])
    if part:
        if following:
            kept, joined = words.read(part + "-" + following), words.read(part + following)
            belongs = kept[1] in words.counts and kept[0] < joined[0]
            if not belongs and joined[2] and not joined[1].startswith(part.lower()):
                kinds.add("ocr_char")
        else:
            belongs = words.known(part) and part.lower() in words.openers
        if not belongs:
            kinds.add("hyphen")
    if before and tokens and inner.start:
        joined = words.read(before + tokens[0])
        if joined[2] and joined[1].startswith(before.lower()) and words.read(before + "-" + tokens[0])[1] not in words.counts:
            kinds.add("ocr_char")
    return "".join(out), kinds


_FOLD_ONE = str.maketrans({"0": "o", "1": "l", "!": "i", "5": "s", "6": "b", "8": "b", "9": "g", "7": "t", "q": "g", "f": "t"})
_FOLD_TWO = (("rn", "m"), ("ri", "n"), ("cl", "d"), ("li", "h"), ("ii", "u"), ("vv", "w"))


def fold(line: str) -> str:
    """A key under which a title and its misread forms fall together."""
    s = re.sub(r"(?<=[a-z])7|7(?=[a-z])", "t", line.lower())
    digits = re.match(r"^(?:[^\W\d_]+\s+)?\d{1,4}\b", s)
    head, s = (s[: digits.end()], s[digits.end() :]) if digits else ("", s)
    s = s.translate(_FOLD_ONE)
    for a, b in _FOLD_TWO:
        s = s.replace(a, b)
    return re.sub(r"[\W_]+", "", head + s.replace("c", "e"))


def clean_title(title: str | None) -> str:
    """A title without page number, line ends and disguised characters."""
    if not title:
        return ""
    text = canonical(title, forms=False)[0]
    text = _TITLE_PAGE.sub("", text)
    return re.sub(rf"[{HYPHENS}]\s*[\n\r]+\s*", "", text).strip()


def title_keys(titles: list[str | None]) -> set[str]:
    out = set()
    for t in titles:
        c = clean_title(t)
        for form in (c, re.sub(rf"(\w)[{HYPHENS}] (?=[a-z])", r"\1", c), _PREFIX.sub("", c)):
            if len(key := fold(form)) >= 3:
                out.add(key)
    return out


def number_of(text: str) -> int | None:
    if text.isdigit():
        return int(text)
    values, total, last = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}, 0, 0
    for ch in reversed(text.lower()):
        v = values.get(ch)
        if v is None:
            return None
        total, last = (total - v, last) if v < last else (total + v, v)
    return total


def _number_in(m: re.Match) -> int | None:
    return number_of(next(g for g in m.groups() if g))


def edge_numbers(text: str | None) -> list[int]:
    """Numbers that stand alone (or beside a header) on the outer two lines at either end of a page."""
    lines = (text or "").strip().splitlines()
    out = []
    for line in {*lines[:2], *lines[-2:]} if len(lines) > 1 else ():
        if m := _STRONG.match(line) or _BARE.match(line) or (len(line) < 70 and (_BEFORE.match(line) or _AFTER.search(line))):
            if (v := _number_in(m)) is not None:
                out.append(v)
    return out


def _sentence_case(line: str) -> bool:
    """A heading in the text: only its first word is capitalised."""
    tokens = [w for w in re.findall(r"[^\W_]+", line) if _LETTER.search(w)]
    return len(tokens) > 1 and all(w[0].islower() for w in tokens[1:]) and any(len(w) > 3 for w in tokens[1:])


def _may_be_header(line: str) -> bool:
    """A line that may be a running header where it repeats: no end of a sentence, no continued text."""
    return bool(line) and len(line) < 90 and not line[0].islower() and not re.search(r"[.,;:!?]$", line) and not _sentence_case(line)


def page_parts(text: str, keys: set[str], offset: int | None, index: int | None) -> tuple[list[str], list[str], bool]:
    """(header lines, body lines, whether there is a page number)."""
    lines = text.strip("\n\r").splitlines()
    headers, number = [], False

    def is_number(line: str, other: str) -> bool:
        if m := _STRONG.match(line):
            return True
        if m := _BARE.match(line):
            v = _number_in(m)
            if offset is not None and index is not None and v is not None:
                return v - index == offset
            return line.strip().isdigit() and not _BARE.match(other or "")
        return False

    def header(line: str) -> tuple[bool, bool]:
        """(is a running header, has a page number)"""
        core, found = line.strip(), False
        for pattern in (_BEFORE, _AFTER):
            if m := pattern.search(core):
                rest = (core[: m.start()] + core[m.end() :]).strip()
                if fold(rest) in keys:
                    core, found = rest, True
                    break
        key = fold(core)
        if not core or len(core) > 90 or len(key) < 3:
            return False, False
        hit = key in keys or (len(key) > 8 and any(abs(len(key) - len(k)) <= 1 and _near(key, k) for k in keys))
        return (hit and not _sentence_case(core)), found

    for _ in range(2):
        if len(lines) > 1 and not headers:
            hit, with_number = header(lines[0])
            if hit:
                headers.append(lines.pop(0))
                number |= with_number
                continue
        if len(lines) > 1 and not number and is_number(lines[0], lines[1]):
            number = True
            lines.pop(0)
    for _ in range(2):
        if len(lines) > 1 and not number and is_number(lines[-1], lines[-2]):
            number = True
            lines.pop()
            continue
        if len(lines) > 1 and not headers:
            hit, with_number = header(lines[-1])
            if hit:
                headers.append(lines.pop())
                number |= with_number
    return headers, lines, number


def _near(a: str, b: str) -> bool:
    """At most one edit between two keys."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


def paragraph_ends(lines: list[str]) -> list[bool]:
    """For each line whether a paragraph ends with it: the cheapest series of decisions.

    A break after a full line or one without a final mark costs; so does none after a short line
    whose next word would have fitted; single-line paragraphs cost a little.
    """
    if not lines:
        return []
    width = max(map(len, lines))
    state = {True: (0.0, [])}  # whether the line before ended a paragraph
    for i, line in enumerate(lines):
        nxt = lines[i + 1] if i + 1 < len(lines) else ""
        fits = len(line) + 1 + len(nxt.split(" ", 1)[0]) <= width - 1
        final = bool(re.search(r"[.!?…:][\"'”’)\]]*$", line.rstrip()))
        starts = nxt[:1].isupper() or not nxt[:1].isalpha()
        brk = (0.0 if final else 3.0) + (0.0 if fits else 3.0) + (0.0 if starts else 4.0)
        keep = 4.0 if fits and starts else 0.5 if fits else 0.0
        new = {}
        for ended, (cost, path) in state.items():
            for end, c in ((True, brk + (0.5 if ended else 0.0)), (False, keep)):
                if i + 1 == len(lines):
                    end, c = False, 0.0
                if end not in new or cost + c < new[end][0]:
                    new[end] = (cost + c, [*path, end])
        state = new
    return min(state.values())[1]


def repair_page(text: str | None, keys: set[str], words: Words, following: str = "", offset: int | None = None, index: int | None = None, before: str = "") -> tuple[list[str], bool, list[str]]:
    """(paragraphs, whether the last one runs on, kinds of noise) of a page."""
    if not text or not text.strip():
        return [], False, []
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    headers, lines, number = page_parts(text, keys, offset, index)
    kinds = ({"header"} if headers else set()) | ({"page_number"} if number else set())
    for h in headers:
        kinds |= {k for k in decode(h, words)[1] if k == "ocr_char"}
    ends = paragraph_ends(lines)
    body = "".join(line.rstrip() + ("\n" if not end else "\n\n") for line, end in zip(lines, ends)).rstrip("\n")
    clean, more = decode(body, words, following, before)
    paragraphs = [re.sub(r"\s*\n\s*", " ", p) for p in re.split(r"\n\n+", clean) if p.strip()]
    runs_on = not re.search(r"[.!?…][\"'”’)\]]*\s*$", body)
    return paragraphs, runs_on, sorted(kinds | more)


def repair_title(title: str | None, words: Words) -> tuple[str | None, list[str]]:
    if not title or not title.strip():
        return title, []
    kinds, text = set(), canonical(title, forms=False)[0]
    if m := _TITLE_PAGE.search(text):
        kinds.add("page_number")
        text = text[: m.start()]
    clean, more = decode(text, words)
    return re.sub(r"\s+", " ", clean).strip(), sorted(kinds | more)


def scanned_books(projects: DataFrame) -> DataFrame:
    """project_id and book_title of the scanned books, once each."""
    scanned = projects.filter((F.col("source_format") == "pdf") & (F.col("document_type") == "textbook") & F.col("project_id").isNotNull())
    return scanned.groupBy("project_id").agg(F.max("title").alias("book_title"))


def word_counts(paragraphs: DataFrame, books: DataFrame) -> dict[str, int]:
    """Counts of the words outside scanned books (see the module's text)."""
    rows = paragraphs.join(books.select("project_id", F.lit(True).alias("_scan")), "project_id", "left").select(F.col("original_text").alias("t"), F.coalesce("_scan", F.lit(False)).alias("scan")).filter("t is not null")

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clean, noisy = Counter(), Counter()
        for pdf in filter(len, it):
            for t, scan in zip(pdf["t"], pdf["scan"]):
                (noisy if scan else clean).update(_WORD.findall(t.lower()))
            if len(clean) + len(noisy) > 500_000:
                yield _frame(clean, noisy)
                clean, noisy = Counter(), Counter()
        yield _frame(clean, noisy)

    def _frame(clean: Counter, noisy: Counter) -> pd.DataFrame:
        w = [*clean, *(x for x in noisy if x not in clean)]
        return pd.DataFrame({"word": w, "clean": [clean[x] for x in w], "noisy": [noisy[x] for x in w]}, dtype=object)

    counts = rows.mapInPandas(count, "word string, clean long, noisy long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("noisy").alias("noisy"))
    both = F.col("clean") + F.col("noisy")
    counts = checkpointed(counts)
    tokens = counts.agg(F.sum(both)).collect()[0][0] or 0
    return _choose(counts.filter(both >= max(MIN_COUNT, math.ceil(tokens * MIN_SHARE))).collect())


def _choose(rows: list) -> dict[str, int]:
    clean = {r.word: r.clean for r in rows if r.clean >= MIN_COUNT}
    if clean:
        return clean
    noisy = {r.word: r.noisy for r in rows}
    return {w: n for w, n in noisy.items() if not any(noisy.get(v, 0) >= 20 * n for v in variants(w))}


def repair_books(paragraphs: DataFrame, chapters: DataFrame, projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, titles) of the scanned books.

    pages: row_id, project_id, chapter_id, para_index, paragraphs array, runs_on, kinds array.
    titles: chapter_row_id, title, kinds array.
    """
    books = scanned_books(projects)
    words = word_counts(paragraphs, books)
    shared = paragraphs.sparkSession.sparkContext.broadcast(words)  # at most 1 / MIN_SHARE words
    pages = paragraphs.join(books, "project_id").select("row_id", "project_id", "chapter_id", "para_index", F.col("original_text").alias("text"), "book_title")

    # What stands at the edges of the pages: numbers, first lines, and the first word after them.
    def edges(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filter(len, it):
            tops, numbers, tails = [], [], []
            for t in pdf["text"]:
                m = _TAIL.search(t or "")
                tails.append(m.group(1) if m else "")
                first = next((x for x in (t or "").strip().splitlines() if not (_STRONG.match(x) or _BARE.match(x))), "")
                core = _AFTER.sub("", _BEFORE.sub("", first.strip()))
                tops.append(fold(core) if _may_be_header(core) else "")
                numbers.append(edge_numbers(t))
            yield pd.DataFrame({"project_id": pdf["project_id"].tolist(), "chapter_id": pdf["chapter_id"].tolist(), "para_index": pdf["para_index"].tolist(), "top": tops, "numbers": numbers, "tail": tails}, dtype=object)

    edge = checkpointed(pages.select("project_id", "chapter_id", "para_index", "text").mapInPandas(edges, "project_id string, chapter_id string, para_index int, top string, numbers array<int>, tail string"))
    offsets = edge.select("project_id", "para_index", F.explode("numbers").alias("v")).select("project_id", (F.col("v") - F.col("para_index")).alias("offset")).groupBy("project_id", "offset").count().filter("count >= 3")
    offsets = offsets.groupBy("project_id").agg(F.max_by("offset", F.struct("count", "offset")).alias("offset"))
    tops = edge.filter("length(top) >= 3").groupBy("project_id", "top").agg(F.count("*").alias("n")).filter("n >= 3").groupBy("project_id").agg(F.collect_set("top").alias("tops"))

    tails = edge.filter("tail != ''").groupBy("project_id", (F.col("para_index") + 1).alias("para_index")).agg(F.max("tail").alias("tail"))

    titles = chapters.join(books, "project_id").filter("title is not null").groupBy("project_id", "chapter_id").agg(F.max("title").alias("chapter_title"))
    full = pages.join(titles, ["project_id", "chapter_id"], "left").join(offsets, "project_id", "left").join(tops, "project_id", "left").join(tails, ["project_id", "para_index"], "left")

    # The whole next page, for pages that end inside a word; no other page is sent.
    open_end = F.coalesce(F.col("text").rlike(rf"[{HYPHENS}]\s*(?:\n[^\n]{{0,14}})?\s*$"), F.lit(False))
    wanted = pages.filter(open_end).select("project_id", (F.col("para_index") + 1).alias("para_index")).distinct()
    heads = pages.join(wanted, ["project_id", "para_index"], "left_semi").groupBy("project_id", (F.col("para_index") - 1).alias("para_index")).agg(F.min_by("text", "row_id").alias("next_text"))
    plain = full.filter(~open_end).withColumn("next_text", F.lit(None).cast("string"))
    full = plain.unionByName(full.filter(open_end).join(heads, ["project_id", "para_index"], "left"))

    def repair(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Words(shared.value)
        keys_of: dict[tuple, set[str]] = {}
        for pdf in filter(len, it):
            done = []
            for r in pdf.itertuples(index=False):
                offset = None if r.offset != r.offset or r.offset is None else int(r.offset)
                index = None if r.para_index != r.para_index or r.para_index is None else int(r.para_index)
                ident = (r.project_id, r.chapter_id)
                if ident not in keys_of:
                    keys_of[ident] = title_keys([r.book_title, r.chapter_title]) | set(r.tops if r.tops is not None else ())
                keys = keys_of[ident]
                following = ""
                if isinstance(r.next_text, str):
                    body = page_parts(r.next_text, keys, offset, None if index is None else index + 1)[1]
                    m = next(filter(None, map(_TOKEN.search, body)), None)
                    following = m.group() if m else ""
                done.append(repair_page(r.text, keys, known, following, offset, index, r.tail if isinstance(r.tail, str) else ""))
            yield pdf[["row_id", "project_id", "chapter_id", "para_index"]].astype({"project_id": object, "chapter_id": object}).assign(paragraphs=[d[0] for d in done], runs_on=[d[1] for d in done], kinds=[d[2] for d in done])

    repaired = full.mapInPandas(repair, "row_id long, project_id string, chapter_id string, para_index int, paragraphs array<string>, runs_on boolean, kinds array<string>")

    def retitle(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Words(shared.value)
        for pdf in filter(len, it):
            done = [repair_title(t, known) for t in pdf["title"]]
            yield pd.DataFrame({"chapter_row_id": pdf["chapter_row_id"].tolist(), "title": [d[0] for d in done], "kinds": [d[1] for d in done]}, dtype=object)

    retitled = chapters.join(books, "project_id").select("chapter_row_id", "title").mapInPandas(retitle, "chapter_row_id long, title string, kinds array<string>")
    return repaired, retitled


def continuous(pages: DataFrame) -> DataFrame:
    """project_id, chapter_id, row_id, place, n_pages, text: the paragraphs of scanned books, each from the page where it begins (row_id) over all pages that it runs on to.

    A page that is delivered several times is taken once, by its least row_id; a page without its
    next one ends its paragraph. Pages meet their neighbours by their number, so no book is one
    task's work; a paragraph over n pages takes log n rounds.
    """
    cols = F.struct("row_id", "chapter_id", "paragraphs", "runs_on", "kinds")
    page = pages.filter("project_id is not null and para_index is not null and size(paragraphs) > 0").groupBy("project_id", "para_index").agg(F.min_by(cols, "row_id").alias("p")).select("project_id", "para_index", "p.*")
    page = checkpointed(page)
    before = page.select("project_id", (F.col("para_index") + 1).alias("para_index"), F.col("runs_on").alias("_open"))
    page = page.join(before, ["project_id", "para_index"], "left").withColumn("joined", F.coalesce("_open", F.lit(False))).drop("_open")

    # Where the first paragraph of a joined page begins: the page before, unless that is a single joined paragraph itself.
    through = page.filter("joined and size(paragraphs) = 1").select("project_id", F.col("para_index").alias("head"), F.lit(True).alias("_through"))
    heads = page.filter("joined").select("project_id", "para_index", (F.col("para_index") - 1).alias("head")).join(through, ["project_id", "head"], "left")
    heads = checkpointed(heads.select("project_id", "para_index", "head", F.coalesce("_through", F.lit(False)).alias("open")))
    while not heads.filter("open").isEmpty():
        up = heads.select("project_id", F.col("para_index").alias("head"), F.col("head").alias("_head"), F.col("open").alias("_open"))
        further = heads.filter("open").join(up, ["project_id", "head"]).select("project_id", "para_index", F.col("_head").alias("head"), F.col("_open").alias("open"))
        heads = checkpointed(heads.filter("not open").unionByName(further))

    page = page.join(heads.drop("open"), ["project_id", "para_index"], "left")
    each = page.select("project_id", "para_index", "row_id", "chapter_id", "head", "kinds", F.size("paragraphs").alias("n"), F.posexplode("paragraphs").alias("place", "text"))
    own = (F.col("place") == 0) & F.col("head").isNotNull()
    # A paragraph is known by its first page, and by being the last there or by its place.
    last = F.col("place") == F.col("n") - 1
    key = F.when(own, F.lit(-1)).when(last, F.lit(-1)).otherwise(F.col("place"))
    hyphen = F.array_contains("kinds", "hyphen")
    parts = each.select("project_id", F.when(own, F.col("head")).otherwise(F.col("para_index")).alias("page"), key.alias("key"), F.struct("para_index", "text", hyphen.alias("hyphen")).alias("s"), F.struct("para_index", "chapter_id", "row_id", "place").alias("first"))
    whole = parts.groupBy("project_id", "page", "key").agg(F.sort_array(F.collect_list("s")).alias("s"), F.min("first").alias("f"))
    cut = rf"[{HYPHENS}]\s*$"
    text = F.aggregate(
        F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), F.struct(F.element_at("s", 1)["text"].alias("t"), F.element_at("s", 1)["hyphen"].alias("h")),
        lambda acc, x: F.struct(F.concat(F.when(acc["t"].rlike(cut), F.when(acc["h"], F.regexp_replace(acc["t"], cut, "")).otherwise(F.rtrim(acc["t"]))).otherwise(F.concat(acc["t"], F.lit(" "))), x["text"]).alias("t"), x["hyphen"].alias("h")),
        lambda acc: acc["t"],
    )
    return whole.select("project_id", "f.chapter_id", "f.row_id", "f.place", F.size("s").alias("n_pages"), text.alias("text"))


def found(paragraphs: DataFrame, chapters: DataFrame, projects: DataFrame) -> DataFrame:
    pages, titles = repair_books(paragraphs, chapters, projects)
    p = pages.select(F.lit("paragraph").alias("record_kind"), F.col("row_id").alias("record_id"), F.explode("kinds").alias("noise_kind"))
    return p.unionByName(titles.select(F.lit("chapter").alias("record_kind"), F.col("chapter_row_id").alias("record_id"), F.explode("kinds").alias("noise_kind")))
