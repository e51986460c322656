"""Pairs of original and translation that are no usable translation (problem 4).

Each row is judged in the same pass that reads its phrases for problem 2: whether anything is said,
whether the original is given back, the share of its words in sentences of another language (by the
trigram profiles of ``language``), and whether it has anything to do with its original (names, numbers
and entries of the lexicon). The openings of responses that have not are clustered by MinHash: minima
name buckets, the members of a bucket are verified against each other, and verified links make
connected groups. Whole openings are linked by a Jaccard similarity of ``ALIKE`` on their pairs of words (half
of the pairs of two as long are the same), their first words by one of ``SIMILAR`` on shingles of five words. A
group whose openings answer at least ``RECURS`` unrelated originals is a template, and a response with one
of its recurring phrases is a refusal. Cut off translations are those of problem 2.

One defect for each row, in this order: empty, copy, refusal, wrong_language, truncated.

Defined results: a null translation is empty, unless the original says nothing either; rows
whose original has nothing to translate (formulas, numbers, names) are no copies; images, rules,
and rows of another status take no part; repeated rows are judged each.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from . import broken, language
from .bitext import WORD, Lexicon, learn, pairs

SHINGLE, OPENINGS, WINDOW, RECURS = 5, (5, 7, 9), 20, 3
SIMILAR, ALIKE, MINIMA = 0.8, 1 / 3, 24
SOURCE, TARGET = "en", broken.TARGET
_MARKER = re.compile(r"\[{2,}[^\]]*\]{2,}")
_QUOTED = re.compile(r"\[[^\]]*\]")
_NO_ALNUM = re.compile(r"[\W_]+")
_LABEL = re.compile(r"^\W*[^\W\d_][\w ]{0,24}:\s*")
#: Words that stand for no value; fixed values.
_NOTHING = frozenset("null none nil nan na n/a undefined empty todo tbd".split())


def bare(text: str) -> str:
    """Letters and digits only, in lower case: what is left without case, spacing and mark-up."""
    return _NO_ALNUM.sub("", text.casefold())


def said(text: str) -> bool:
    core = (_MARKER.sub("", text) if "[[" in text else text).strip()
    return any(c.isalnum() for c in core) and (len(core) > 20 or core.strip(" .()[]<>*-_").casefold() not in _NOTHING)


def translatable(tokens: list[str], lexicon: Lexicon) -> bool:
    """Whether a word of the original has a translation."""
    return any(w.lower() in lexicon.entries for w in tokens if w.isalpha() and len(w) > 1)


def is_copy(original: str, translated: str) -> bool:
    core = _MARKER.sub("", translated) if "[[" in translated else translated
    if any(c.isalnum() for c in set(original.casefold()).difference(core.casefold())):
        return False  # a copy holds every letter of its original
    o = bare(original)
    if not o:
        return False
    t = bare(core)
    return t == o or bare(_LABEL.sub("", core)) == o or (len(o) > 12 and o in t and len(t) <= 1.2 * len(o) + 30)


def related(source: list[str], target: list[str], text: str, lexicon: Lexicon) -> bool:
    """Whether the translation shows a fifth of the original's names, numbers and lexicon words, or the original has none.

    The open rest of a translation shows little of it, but a name or number, or is itself made of what the original calls for: then it is, too.
    No more words are looked up than decide: a fifth of all words is enough.
    """
    entries, own = lexicon.entries, set(source)
    tokens, two = set(target), set(pairs([w.lower() for w in target]))
    got = total = named = 0
    for w in own:
        entry = entries.get(w.lower())
        if w.isdigit() or (w[0].isupper() and not entry):
            total += 1
            if w in tokens:
                got, named = got + 1, 1
        elif entry:
            total += 1
            if not two.isdisjoint(entry):
                top = 0.5 * max(entry.values())
                got += any(d >= top and t in two for t, d in entry.items())
        if 5 * got >= len(own):
            return True
    if 5 * got >= total:
        return True
    if not two or broken.open_rest(text.strip()) is None:
        return False
    called = {t for w in own if (entry := entries.get(w.lower())) for t in entry}
    return bool(named) or len(two & called) >= 0.5 * len(two)


def opening_of(text: str) -> str | None:
    """The first words of a response without what it quotes; None if they make no shingle."""
    tokens = [w.lower() for w in WORD.findall(_QUOTED.sub(" ", text))[:WINDOW]]
    return " ".join(tokens) if len(tokens) >= SHINGLE else None


def judge(lexicon: Lexicon, source_lang: str = SOURCE, target_lang: str = TARGET) -> broken.Judge:
    """A judge of single rows: (defect that the row shows by itself, opening if it has nothing to do with its original, hash of the original)."""

    def signs(o: str, t: str, src: list[str], sentences: list[list[str]], langs: list[str]) -> tuple[str | None, str | None, int] | None:
        if not said(t):
            return ("empty", None, 0) if said(o) or not bare(t) and any(c.isalnum() for c in o) else None
        if is_copy(o, t):
            return ("copy", None, 0) if translatable(src, lexicon) else None
        words: dict[str, int] = {}
        for tokens, lang in zip(sentences, langs):
            if lang:
                words[lang] = words.get(lang, 0) + len(tokens)
        foreign = 2 * words.get(target_lang, 0) < sum(words.values())
        if not foreign or words.get(source_lang, 0) * 2 >= sum(words.values()):  # only these may be refusals
            own = [w for tokens in sentences for w in tokens]
            if "[" in t:
                own = WORD.findall(_QUOTED.sub(" ", t))
            if not related(src, own, _QUOTED.sub(" ", t) if "[" in t else t, lexicon) and (opening := opening_of(t)):
                return None, opening, xxhash.xxh64_intdigest(o) >> 1
        return ("wrong_language", None, 0) if foreign else None

    return signs


def _shingles(words: Column, n: int = SHINGLE) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.array_join(F.slice(words, i + 1, n), " ")))


def _bucket_links(bucket: list[tuple[str, frozenset[int]]], similar: float) -> Iterator[tuple[str, str]]:
    """Verified links of a bucket's members (opening, shingles); they connect what all of its verified links connect.

    Members that are connected already are not compared again. Others are if one of the rarest shingles of
    the one is among the rarest of the other: sets of n and m shingles need a certain number in
    common, and if they have it, not all of it lies among the frequent ones.
    """
    often = Counter(s for _, own in bucket for s in own)
    sizes = sorted({len(own) for _, own in bucket})
    up = list(range(len(bucket)))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def needed(n: int, m: int) -> int:
        return math.ceil(similar / (1 + similar) * (n + m) - 1e-9)

    looked_up = {n: [(m, n - needed(n, m) + 1) for m in sizes if needed(n, m) <= min(n, m)] for n in sizes}
    holders: dict[tuple[int, int], dict[int, list[int]]] = {}  # by size and shingle, and by connected group
    for i, (opening, own) in enumerate(bucket):
        rarest, n = sorted(own, key=lambda s: (often[s], s)), len(own)
        mine, missed = i, set()
        for m, first in looked_up[n]:
            for s in rarest[:first]:
                if not (groups := holders.get((m, s))):
                    continue
                for g in [*groups]:
                    if (now := top(g)) != g:
                        groups.setdefault(now, []).extend(groups.pop(g))
                for g, members in groups.items():
                    if g == mine or top(g) == mine:
                        continue
                    for j in members:
                        if j in missed:
                            continue
                        both = len(own & bucket[j][1])
                        if both >= similar * (n + m - both):
                            yield opening, bucket[j][0]
                            up[mine] = mine = top(j)
                            break
                        missed.add(j)
        for s in rarest[: n - math.ceil(similar * n - 1e-9) + 1]:
            holders.setdefault((n, s), {}).setdefault(mine, []).append(i)


def _linked(openings: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """a, b: links of the openings (opening, shingles) with a similarity of at least ``similar``, among those that share a least hash; each is linked with itself.

    Of the verified links of a bucket, those come that connect its members: never more than these. A
    task holds the openings of one bucket.
    """
    hashed = openings.select("opening", F.transform("shingles", lambda s: F.xxhash64(s)).alias("shingles"))
    least = [F.xxhash64(F.lit(i), F.array_min(F.transform("shingles", lambda s: F.xxhash64(F.lit(i), s)))) for i in range(MINIMA)]
    members = hashed.select(F.explode(F.array(*least)).alias("bucket"), "opening", "shingles")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, bucket = None, []

        def links() -> pa.RecordBatch:
            found = list(_bucket_links(bucket, similar)) if len(bucket) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in (0, 1)], ["a", "b"])

        for batch in it:
            for key, opening, shingles in zip(*(c.to_pylist() for c in batch.columns)):
                if key != last:
                    if len(bucket) > 1:
                        yield links()
                    last, bucket = key, []
                bucket.append((opening, frozenset(shingles)))
        yield links()

    near = members.repartition("bucket").sortWithinPartitions("bucket", "opening").mapInArrow(run, "a string, b string")
    return near.unionByName(openings.select(F.col("opening").alias("a"), F.col("opening").alias("b"))).distinct()


def _groups(links: DataFrame) -> DataFrame:
    """opening, group: connected openings share the least of them."""
    ways = checkpointed(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    named = ways.groupBy(F.col("a").alias("opening")).agg(F.min("b").alias("group"))
    while True:
        near = ways.join(named.withColumnRenamed("opening", "b"), "b").groupBy(F.col("a").alias("opening")).agg(F.min("group").alias("near"))
        new = checkpointed(named.join(near, "opening").select("opening", F.least("group", "near").alias("group"), (F.col("near") < F.col("group")).alias("moved")))
        named = new.select("opening", "group")
        if new.filter("moved").isEmpty():
            return named


def refusals(shown: DataFrame) -> DataFrame:
    """row_id of the responses (row_id, opening, prompt) that follow a template of refusal.

    The clusters are of whole openings (WINDOW words) and of their first words, by each number of OPENINGS. A shingle of an opening that recurs
    within a template is one of its phrases; responses that hold one are refusals, and what recurs in these is a phrase, too.
    """
    heads = F.array_distinct(F.array(*[F.array_join(F.slice("words", 1, n), " ") for n in OPENINGS]))
    prompts = checkpointed(shown.filter("opening is not null").select("opening", "prompt", F.split("opening", " ").alias("words")).select("opening", "prompt", heads.alias("heads"), _shingles(F.col("words")).alias("shingles")).distinct())
    words = F.split("opening", " ")
    opened = prompts.select(F.explode("heads").alias("opening")).distinct().select("opening", _shingles(words).alias("shingles"))
    whole = prompts.select("opening").distinct().select("opening", _shingles(words, 2).alias("shingles"))
    groups = _groups(_linked(opened).unionByName(_linked(whole, ALIKE))).select(F.col("opening").alias("head"), "group")
    grouped = prompts.select("prompt", "shingles", F.explode(F.array_union("heads", F.array("opening"))).alias("head")).join(groups, "head")
    templates = grouped.select("group", "prompt").distinct().groupBy("group").count().filter(F.col("count") >= RECURS).select("group")
    members = grouped.join(templates, "group", "left_semi").select("group", "prompt", F.explode("shingles").alias("shingle"))
    phrases = members.distinct().groupBy("group", "shingle").count().filter(F.col("count") >= RECURS).select("shingle").distinct()
    each = prompts.select("opening", "prompt", F.explode("shingles").alias("shingle"))
    known = -1
    while True:
        phrases = checkpointed(phrases)
        held = each.join(phrases, "shingle", "left_semi").select("opening").distinct()
        if (n := phrases.count()) == known or not n:
            return shown.join(held, "opening", "left_semi").select("row_id").distinct()
        known = n
        again = each.join(held, "opening", "left_semi").select("shingle", "prompt").distinct().groupBy("shingle").count().filter(F.col("count") >= RECURS)
        phrases = again.select("shingle").unionByName(phrases).distinct()


def flagged(paragraphs: DataFrame, documents: DataFrame) -> DataFrame:
    """row_id, defect of each defective pair."""
    lexicon = learn(paragraphs)
    judged = F.coalesce(F.col("status").isin("done", "edited"), F.lit(False)) & ~F.coalesce(F.col("tag").isin("img", "hr"), F.lit(False))
    rows = paragraphs.filter(judged | broken.translated()).select("row_id", judged.alias("judged"), "original_text", "translated_text")
    scanned = checkpointed(broken.scan(rows, lexicon, language.learn(documents), judge(lexicon)))
    shown = scanned.filter("row_id is not null and value is null").select("row_id", "defect", "opening", "prompt")
    refused = refusals(shown).withColumn("refusal", F.lit(True))
    cut = broken.cut_rows(scanned).join(paragraphs.filter(judged).select("row_id"), "row_id", "left_semi").withColumn("cut", F.lit(True))
    all_ = shown.select("row_id", "defect").join(refused, "row_id", "left").join(cut, "row_id", "full_outer")
    first = F.when(F.col("defect").isin("empty", "copy"), F.col("defect")).when(F.col("refusal"), F.lit("refusal")).when(F.col("defect").isNotNull(), F.col("defect")).when(F.col("cut"), F.lit("truncated"))
    return all_.select("row_id", first.alias("defect")).filter("defect is not null")


def found(paragraphs: DataFrame, documents: DataFrame) -> DataFrame:
    return flagged(paragraphs, documents)


def report(paragraphs: DataFrame, documents: DataFrame) -> DataFrame:
    """Defective pairs by provider and defect."""
    return flagged(paragraphs, documents).join(paragraphs.select("row_id", "provider"), "row_id").groupBy("provider", "defect").agg(F.count("*").alias("rows"))
