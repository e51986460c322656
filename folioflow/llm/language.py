"""Language of short texts by character trigrams; used by problems 2 and 4.

A profile counts the hashed trigrams of the words of all documents of a language; capitalised words,
such as names, and digits take no part, since they stand in texts of any language. A sentence is of
the language under which its trigrams are likeliest. One whose trigrams that language mostly lacks
is of none of them: so a language that no document has is still told from the ones that are known.

The model is a table of ``BUCKETS`` numbers for each language: at most ``MOST`` languages, told by
the letters of ``documents.lang`` without case and outer blanks, have a column of their own.

Defined results: documents without language or text take no part; a text without a word in lower
case has no language (an empty string); with no documents every language is unknown.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import TRIM
from .bitext import WORD

BUCKETS, MOST = 1 << 16, 64
SMOOTH = 0.05
#: Share of a sentence's trigrams that a language must have seen, more often than this rate.
SEEN, RARE = 0.6, 2e-5
OTHER = "other"


def spoken(tokens: list[str]) -> str:
    """The words that tell a language, between blanks."""
    return " ".join([w for w in (t.lstrip("0123456789") for t in tokens) if w and not w[0].isupper()])


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed trigrams of all texts, how many each text has); every text stands between blanks."""
    chars = np.frombuffer(" ".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    if len(chars) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    h = (chars[:-2] * np.uint64(0x9E3779B1) + chars[1:-1] * np.uint64(0x85EBCA77) + chars[2:] * np.uint64(0xC2B2AE3D)) & np.uint64(0xFFFFFFFF)
    h = ((h ^ (h >> np.uint64(15))) * np.uint64(0x2C1B3C6D)) & np.uint64(0xFFFFFFFF)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1  # the blank before each text
    inside = np.zeros(len(h) + 1, dtype=np.int64)  # trigrams that run into the next text do not count
    real = lengths > 0
    np.add.at(inside, starts[real], 1)
    np.add.at(inside, starts[real] + lengths[real], -1)
    return ((h ^ (h >> np.uint64(16))) % np.uint64(BUCKETS)).astype(np.int64)[np.cumsum(inside)[:-1] > 0], lengths


@dataclass
class Profiles:
    """names of the languages; log likelihoods and whether a trigram is seen (BUCKETS x languages)."""

    names: list[str]
    score: np.ndarray
    seen: np.ndarray

    def languages(self, texts: list[str], least: int = 6) -> list[str]:
        """The language of each text (of ``spoken`` form): a name, OTHER, or an empty string below ``least`` trigrams."""
        grams, n = trigrams(texts)
        out = [""] * len(texts)
        if not len(grams) or not self.names:
            return [OTHER if k >= least else "" for k in n] if not self.names else out
        has = np.flatnonzero(n)
        at = (np.cumsum(n) - n)[has]
        score = np.add.reduceat(self.score[grams], at, axis=0)
        best = score.argmax(axis=1)
        known = np.add.reduceat(self.seen[grams], at, axis=0, dtype=np.float64)[np.arange(len(has)), best] / n[has]
        for i, b, k in zip(has.tolist(), best.tolist(), known.tolist()):
            if n[i] >= least:
                out[i] = self.names[b] if k >= SEEN else OTHER
        return out


def learn(documents: DataFrame) -> Profiles:
    """The profiles of all documents of a known language."""
    lang = F.lower(F.regexp_replace(F.col("lang").cast("string"), TRIM, ""))
    rows = documents.select(lang.alias("lang"), F.col("text").cast("string").alias("text")).filter("lang != '' and text is not null")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in it:
            by: dict[str, list[str]] = {}
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by.setdefault(name, []).append(spoken(WORD.findall(text)))
            for name, texts in by.items():
                counts[name] = counts.get(name, 0) + np.bincount(trigrams(texts)[0], minlength=BUCKETS)
        for name, c in counts.items():
            used = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used.astype("int32")), pa.array(c[used].astype("int64"))], ["lang", "bucket", "n"])

    partial = rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # One row a language, then at most BUCKETS numbers of each that is kept.
    packed = partial.groupBy("lang").agg(F.sum("n").alias("total"), F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("counts"))
    found = packed.orderBy(F.desc("total"), "lang").limit(MOST).collect()
    counts = np.zeros((BUCKETS, len(found)))
    for i, r in enumerate(found):
        counts[r.buckets, i] = r.counts
    total = np.maximum(counts.sum(axis=0), 1.0)
    rate = (counts + SMOOTH) / (total + SMOOTH * BUCKETS)
    return Profiles([r.lang for r in found], np.log(rate).astype("float32"), counts > RARE * total)
