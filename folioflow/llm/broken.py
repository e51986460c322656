"""Translations that break off (problem 2).

A translation is open if it does not end with a sentence mark; closing quotes, brackets,
ellipses and remains of a cut character do not count. The open rest, from its last connecting word on, is looked
up among the phrases of all translations: the corpus is cut into phrases at connecting words, names
and numbers (which match those of the original and become slots), and a self-join by prefix over the
sorted values finds the rests that are strict prefixes of longer phrases elsewhere. The exact
check then asks whether the rest is also a whole phrase elsewhere, and if so how much of what the
lexicon expects for its original sentence is missing.

Defined results: null and blank translations, and ones without any word, are not cut off; a
missing final mark alone is none; a rest is judged against the sentence of the original that it
matches best, so an original that ends openly is no reason; repeated rows are judged each. ``CONNECTORS``
are of the target language; for another one, give its own and its code in ``documents.lang``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from . import language
from .bitext import WORD, Lexicon, learn, match, pairs, plain, sentences
from .language import Profiles, spoken

TARGET = "vi"

#: Connecting words of Vietnamese at which a phrase begins; fixed values.
CONNECTORS = frozenset("và về của với ở từ đến cho vào gần sau là rằng hơn cùng mà có đã được như thì nhưng vì để khi trước bất còn rồi hay hoặc tại trong bằng lại".split())
MISSING = 0.08
LEAST_OWN = 0.4
_CLOSERS = re.compile(r"(?:[\s\"'”’»)\]}…�]|\.{2,})+$")
_MARKED = re.compile(r"[.!?。！？]$")
_SENTENCE_MARK = re.compile(r"[^\d\s][.!?…](?=\s|$)|\d[.!?…](?=\s*$)")  # not the number of a title


def open_rest(text: str) -> str | None:
    """The open last sentence of a translation, or None if it is closed or empty."""
    core = _CLOSERS.sub("", text)
    if core.endswith(".") and text[len(core) :].startswith("."):
        core = core[:-1]
    if not core or _MARKED.search(core):
        return None
    spans = sentences(core)
    return core[spans[-1][0] :] if spans else None


def open_alike(source: str, text: str) -> bool:
    """Both end with the same mark that leaves a sentence open."""
    ends = [re.search(r"(\.{2,}|[:;,—–…-])[\s\"'”’»)\]]*$", x) for x in (source, text)]
    return all(ends) and _kind(ends[0].group(1)) == _kind(ends[1].group(1))


def _kind(mark: str) -> str:
    return "…" if mark.startswith("..") else "—" if mark in "–-" else mark


_NO_ENTRY = {"": 0.0}
_BEGINS = CONNECTORS | {"#", "@"}


def phrases(tokens: list[str], shared: set[str]) -> list[str]:
    """The phrases of a sentence in lower case; one that goes on has an arrow at its end.

    Names and numbers that stand in the original (``shared``) too become slots.
    """
    out: list[str] = []
    phrase: list[str] = []
    last = ""
    for w in tokens:
        if w in shared and not w[0].islower():
            slot = "#" if w[0].isdigit() else "@"
            if slot == last:
                continue
            last = slot
        else:
            last = w.lower()
        if phrase and last in _BEGINS:
            out.append(" ".join(phrase) + " >")
            phrase = []
        phrase.append(last)
    if phrase:
        out.append(" ".join(phrase))
    return out


def _rendered(entry: dict[str, float], two: set[str]) -> bool:
    """Most of the target pairs that belong to the word are there; or none of them, but another sense."""
    top = max(entry.values())
    strong = [t for t, d in entry.items() if d >= 0.95 * top]
    have = sum(t in two for t in strong)
    return have >= 0.6 * len(strong) or (not have and any(t in two for t in entry))


def expected(source: str, tokens: set[str], two: set[str], lexicon: Lexicon, shared: set[str]) -> tuple[float, float]:
    """(number of source words that a rendering must show, number of those that are shown).

    A word counts by itself or within a pair: whichever is rendered decides.
    """
    own = WORD.findall(source)
    low = [w.lower() for w in own]
    total = got = 0.0
    around = pairs(low)
    for i, w in enumerate(own):
        if w.isdigit():
            total, got = total + 1.5, got + 1.5 * (w in tokens)
            continue
        items = [low[i], *around[max(i - 1, 0) : i + 1]]
        entries = [e for x in items if (e := lexicon.entries.get(x))]
        if low[i] in lexicon.idf and max(lexicon.entries.get(low[i], _NO_ENTRY).values()) < LEAST_OWN:
            continue  # a word of the language's own grammar
        if any(max(e.values()) >= 0.85 for e in entries):
            total, got = total + 1, got + any(_rendered(e, two) for e in entries)
        elif w[0].isupper() and w.isalpha() and len(w) > 2 and low[i] not in lexicon.idf:
            total, got = total + 1.5, got + 1.5 * (w in tokens)
    return total, got


def missing_share(source: str, rest: str, lexicon: Lexicon) -> float:
    """Share of the best matching original sentence (or of its last one, if that has less) that the rest lacks.

    1 if it matches none.
    """
    tokens = WORD.findall(rest)
    has, two = set(tokens), set(pairs([t.lower() for t in tokens]))
    spans, shared = sentences(source), set(WORD.findall(source))
    best, least = 0.0, 1.0
    m = match(source, rest, lexicon)
    by: dict[int, float] = {}
    for i, _, w in m.points:
        by[i] = max(w, by.get(i, 0.0))
    scores = [0.0] * len(spans)
    k = 0
    for i in sorted(by):
        while k + 1 < len(spans) and m.src[i].start() >= spans[k + 1][0]:
            k += 1
        scores[k] += by[i]
    for k, (a, b) in enumerate(spans):
        score, sentence = scores[k], source[a:b]
        if score <= 0:
            continue
        if score < best - 1e-6 and k < len(spans) - 1:
            continue
        total, got = expected(sentence, has, two, lexicon, shared)
        share = 1 - got / total if total else 0.0
        if score > best + 1e-6:
            best, least = score, share
        elif (score > best - 1e-6 or k == len(spans) - 1) and share < least:
            least = share
    return least


def open_phrases(original: str, rest: str, tokens: list[str], shared: set[str], lexicon: Lexicon) -> list[tuple[str, float]]:
    """(phrase that an open rest ends with, share of its original that is missing); two if its last word may be part of a connecting one."""
    last = tokens[-1] if tokens else ""
    if last[:1].isupper() and last not in shared and any(x.startswith(last) for x in shared):
        return [((phrases(tokens[:-1], shared) or ["@"])[-1], 1.0)]  # cut inside a name: what stands before it goes on elsewhere
    found = phrases(tokens, shared)
    if not found:
        return []
    missing = missing_share(original, rest, lexicon)
    word = last.lower()
    if not missing and last not in shared and word not in lexicon.syllables and word not in CONNECTORS and not last.isdigit():
        missing = 0.5  # the last word is none: cut inside it
    ends = found[-1].rpartition(" ")[2]
    inside = ends not in CONNECTORS and any(c.startswith(ends) for c in CONNECTORS)
    return [(found[-1], missing), *([(ends, missing)] if inside else [])]


#: What a reader of rows may add for each of them: (defect, opening, prompt), or None.
Judge = Callable[[str, str, list[str], list[list[str]], list[str]], "tuple[str | None, str | None, int] | None"]
SCANNED = "row_id long, value string, n long, missing double, title boolean, defect string, opening string, prompt long"
_NAMES = [c.split()[0] for c in SCANNED.split(", ")]
_ARROW = pa.schema([("row_id", pa.int64()), ("value", pa.string()), ("n", pa.int64()), ("missing", pa.float64()), ("title", pa.bool_()), ("defect", pa.string()), ("opening", pa.string()), ("prompt", pa.int64())])


def scan(rows: DataFrame, lexicon: Lexicon, profiles: Profiles, judge: Judge | None = None, target_lang: str = TARGET) -> DataFrame:
    """One reading of the rows (row_id, judged, original, translation), with three kinds of results.

    Phrases of the corpus (row_id null, summed per batch), open rests (row_id and value), and what
    ``judge`` says of the rows that are to be judged (row_id, no value).
    """
    shared_model = rows.sparkSession.sparkContext.broadcast((lexicon, profiles))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, prof = shared_model.value
        whole: Counter = Counter()
        for batch in it:
            out, rests, texts, at, judged = [], [], [], [], []
            for row_id, wanted, original, translated in zip(*(c.to_pylist() for c in batch.columns)):
                t, o = plain(translated).strip(), plain(original)
                src = WORD.findall(o)
                shared = set(src)
                spans = sentences(t)
                tokens = [WORD.findall(t[a:b]) for a, b in spans]
                if t:
                    rest = open_rest(t)
                    alike = rest is not None and open_alike(o, t)
                    title = rest is not None and not _SENTENCE_MARK.search(t) and not _SENTENCE_MARK.search(o)
                    for words in tokens if rest is None or alike or title else tokens[:-1]:
                        whole.update(phrases(words, shared))
                    if rest is not None and not alike:
                        rests.append((row_id, o, rest, title, shared))
                if wanted and judge is not None:
                    judged.append((row_id, o, t, src, tokens, len(texts)))
                    texts += map(spoken, tokens)
            said = prof.languages(texts)
            for row_id, o, t, src, tokens, first in judged:
                if got := judge(o, t, src, tokens, said[first : first + len(tokens)]):
                    out.append((row_id, None, None, None, None, *got))
            own = [WORD.findall(r[2]) for r in rests]
            foreign = [len(w) >= 4 and lang not in ("", target_lang) for w, lang in zip(own, prof.languages([*map(spoken, own)]))]
            for (row_id, o, rest, title, shared), words, other in zip(rests, own, foreign):
                if not other:  # a rest in another language is no rest of a translation
                    out += [(row_id, v, 0, m, title, None, None, None) for v, m in open_phrases(o, rest, words, shared, lex)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ARROW)], _NAMES)
            if len(whole) > 200_000:
                yield _frame(whole)
                whole = Counter()
        yield _frame(whole)

    def _frame(whole: Counter) -> pa.RecordBatch:
        n, values = len(whole), list(whole)
        counts = [0 if v.endswith(">") else whole[v] for v in values]
        given = {"value": pa.array(values, pa.string()), "n": pa.array(counts, pa.int64())}
        return pa.RecordBatch.from_arrays([given.get(f.name, pa.nulls(n, f.type)) for f in _ARROW], _NAMES)

    return rows.mapInArrow(run, SCANNED)


def strict_prefixes(values: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted values that are strict prefixes of some value; both have one distinct column, value.

    All values are sorted by ranges: what a value is a prefix of stands right behind it. Values are
    distinct, so no range is hot. Between ranges, only the last value of one and the first of the
    next meet: two rows a range, which go to the driver.
    """
    spark = values.sparkSession
    both = values.select("value", F.lit(0).alias("w")).unionByName(wanted.select("value", F.lit(1).alias("w"))).groupBy("value").agg(F.max("w").alias("w"))
    ranged = both.filter("value is not null").repartitionByRange("value").sortWithinPartitions("value").select("value", "w", F.spark_partition_id().alias("part"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_value, part = None, None
        for b in it:
            if not b.num_rows:
                continue
            value, out = b.column(0), []
            if part is None:
                part = b.column(2)[0].as_py()
                out.append((value[0].as_py(), part, 0))
            elif open_value is not None and value[0].as_py().startswith(open_value):
                out.append((open_value, part, 1))
            hits = np.flatnonzero(b.column(1).to_numpy() == 1)
            for i in hits[hits < b.num_rows - 1].tolist():
                v = value[i].as_py()
                if value[i + 1].as_py().startswith(v):
                    out.append((v, part, 1))
            open_value = value[b.num_rows - 1].as_py() if len(hits) and hits[-1] == b.num_rows - 1 else None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.int32())], ["value", "part", "kind"])
        if open_value is not None:
            yield pa.RecordBatch.from_arrays([pa.array([open_value]), pa.array([part], pa.int32()), pa.array([2], pa.int32())], ["value", "part", "kind"])

    done = checkpointed(ranged.mapInArrow(run, "value string, part int, kind int"))
    edges = sorted((r.part, r.kind, r.value) for r in done.filter("kind != 1").collect())
    met = [(a[2],) for a, b in zip(edges, edges[1:]) if a[1] == 2 and b[1] == 0 and b[2].startswith(a[2])]
    return done.filter("kind = 1").select("value").unionByName(spark.createDataFrame(met, "value string"))


def cut_rows(scanned: DataFrame) -> DataFrame:
    """row_id of the translations that break off, by what was scanned."""
    values = scanned.filter("value is not null")
    corpus = values.filter("row_id is null").groupBy("value").agg(F.sum("n").alias("whole"))
    rests = values.filter("row_id is not null").select("row_id", "value", "missing", "title")
    cut = strict_prefixes(corpus.select("value"), rests.select("value").distinct())
    known = rests.join(cut.withColumn("goes_on", F.lit(True)), "value", "left").join(corpus, "value", "left")
    # A row has a second value if its last word may be part of a connecting one; neither may be whole elsewhere.
    rows = known.groupBy("row_id").agg(F.coalesce(F.bool_or("goes_on"), F.lit(False)).alias("goes_on"), F.max(F.coalesce("whole", F.lit(0))).alias("whole"), F.max("missing").alias("missing"), F.bool_or("title").alias("title"))
    # One whole phrase in the corpus proves little (it may be a cut title); none at all is enough by itself in running text.
    never = (F.col("whole") == 0) & ~F.col("title")
    return rows.filter("goes_on").filter(never | ((F.col("whole") <= 1) & (F.col("missing") > 0)) | (F.col("missing") >= MISSING)).select("row_id")


def translated() -> Column:
    return F.length(F.trim("translated_text")) > 0


def found(paragraphs: DataFrame, documents: DataFrame) -> DataFrame:
    """row_id of the translations that break off; ``documents`` give the languages' profiles."""
    rows = paragraphs.filter(translated()).select("row_id", F.lit(False), "original_text", "translated_text")
    return cut_rows(checkpointed(scan(rows, learn(paragraphs), language.learn(documents))))


def report(paragraphs: DataFrame, documents: DataFrame) -> DataFrame:
    """provider, rows with a translation, cut ones and their share; a null provider is a group of its own."""
    cut = found(paragraphs, documents).withColumn("cut", F.lit(1))
    rows = paragraphs.filter(translated()).select("row_id", "provider").join(cut, "row_id", "left")
    return rows.groupBy("provider").agg(F.count("*").alias("translations"), F.count("cut").alias("cut_off")).withColumn("share", F.round(F.col("cut_off") / F.col("translations"), 6))
