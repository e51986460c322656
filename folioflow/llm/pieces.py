"""Splitting oversized items at natural boundaries (problem 1).

A text or file is cut into ranges (of characters, or of bytes) that are scanned independently, each
with a halo on both sides that goes on over white space, so that a boundary on a range's edge is seen
whole. The ranges' boundary tables (offset, strength) are stitched in their order: a prefix sum of
the ranges' lengths turns offsets inside a range into those of the item, and the planner reads one
table after another, keeping no more than those of one room. Pieces are then cut out by offset,
from the ranges that they touch. A text of one range needs no stitching and is done where it is
read. Work grows with the size of an item, and no task holds a file.

Defined results: the size is taken without outer white space; an item of exactly the limit stays
whole; null and blank items give no rows; a piece ends at the strongest boundary of the last
``search`` part of its room (paragraph, line, sentence, clause, word), or at the limit where
there is none; the next piece starts exactly ``overlap`` units before that end. Repeated rows
are separate items.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import BLANK

#: White space at either end; the end is looked for once, at the start of a run, however long runs inside are.
OUTER = rf"^{BLANK}+|(?<!{BLANK}){BLANK}+$"
RANGE = 1 << 16
HALO = 64

#: Strength of a boundary; the offset after its match is the place to cut.
LEVELS = (
    (5, re.compile(r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)\s*")),
    (4, re.compile("\r\n|[\n\r\x0b\f\x85\u2028\u2029]")),
    (3, re.compile(r"[.!?…]+[\"'”’)\]]*\s+|[。！？]+")),
    (2, re.compile(r"[,;:—–|]\s+|[、，；]")),
    (1, re.compile(r"\s+")),
)
KIND = {5: "paragraph", 4: "line", 3: "sentence", 2: "clause", 1: "word", 0: "none"}


def boundaries(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """(offset, strength) of the boundaries in text with start < offset <= end, the strongest for each offset."""
    found: dict[int, int] = {}
    for strength, pattern in LEVELS:
        for m in pattern.finditer(text):
            if start < m.end() <= end:
                found.setdefault(m.end(), strength)
    return sorted(found.items())


class Planner:
    """Plans the pieces of one item while its boundary tables come in, in order."""

    def __init__(self, length: int, limit: int, overlap: int, search: float = 0.5):
        if limit <= overlap:
            raise ValueError("the overlap must be smaller than the limit")
        self.length, self.limit, self.overlap, self.search = length, limit, overlap, search
        self.start = 0
        self.offsets, self.strengths = np.zeros(0, dtype="int64"), np.zeros(0, dtype="int64")

    def feed(self, offsets: np.ndarray, strengths: np.ndarray, until: int) -> list[tuple[int, int, int]]:
        """(start, end, strength of the cut) of the pieces that the boundaries up to ``until`` decide."""
        o, s = np.concatenate([self.offsets, offsets]), np.concatenate([self.strengths, strengths])
        out = []
        while self.length - self.start > self.limit and self.start + self.limit <= until:
            room = self.start + self.limit
            least = max(self.start + self.overlap + 1, self.start + int(self.limit * (1 - self.search)))
            lo, hi = np.searchsorted(o, [least, room + 1])
            if lo == hi:  # nothing in the last part of the room: any boundary that leaves progress
                lo = np.searchsorted(o, self.start + self.overlap + 1)
            end, strength = room, 0
            if lo < hi:
                at = hi - 1 - int(np.argmax(s[lo:hi][::-1]))
                end, strength = int(o[at]), int(s[at])
            out.append((self.start, end, strength))
            self.start = end - self.overlap
        keep = np.searchsorted(o, self.start + self.overlap + 1)
        self.offsets, self.strengths = o[keep:], s[keep:]
        if until >= self.length:
            out.append((self.start, self.length, 0))
        return out


def plan(length: int, offsets: np.ndarray, strengths: np.ndarray, limit: int, overlap: int, search: float = 0.5) -> list[tuple[int, int, int]]:
    """(start, end, strength of the cut) of the pieces of an item of the given length."""
    return Planner(length, limit, overlap, search).feed(np.asarray(offsets), np.asarray(strengths), length)


def range_at(text: str, at: int) -> tuple[str, int, int]:
    """(the range's text with its halos, start and end of the range in it); halos end at no white space."""
    end = min(at + RANGE, len(text))
    lo, hi = max(at - HALO, 0), min(end + HALO, len(text))
    while lo and text[lo - 1].isspace():
        lo -= 1
    while hi < len(text) and text[hi - 1].isspace():
        hi += 1
    return text[lo:hi], at - lo, end - lo


def oversized(items: DataFrame, limit: int, text_col: str = "text") -> DataFrame:
    """The items above the limit in code points without outer white space; ``text`` comes out trimmed."""
    text = F.regexp_replace(F.col(text_col).cast("string"), OUTER, "")
    return items.filter(F.length(text_col) > limit).withColumn(text_col, text).filter(F.length(text_col) > limit)


def split_items(items: DataFrame, keys: list[str], limit: int, overlap: int, text_col: str = "text") -> DataFrame:
    """keys, piece_no, start_offset, end_offset, boundary and piece of each item above the limit."""
    big = oversized(items.select(*keys, text_col), limit, text_col)
    key_types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in big.schema if f.name in keys)
    columns = f"{key_types}, piece_no int, start_offset long, end_offset long, boundary string"
    small = big.filter(F.length(text_col) <= RANGE)

    def whole(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filter(len, it):
            rows = []
            for i, text in enumerate(pdf[text_col]):
                found = boundaries(text, 0, len(text))
                cuts = plan(len(text), np.array([o for o, _ in found], dtype="int64"), np.array([s for _, s in found], dtype="int64"), limit, overlap)
                rows += [(i, k, a, b, KIND[s], text[a:b]) for k, (a, b, s) in enumerate(cuts)]
            flat = pd.DataFrame(rows, columns=["_i", "piece_no", "start_offset", "end_offset", "boundary", "piece"])
            yield pd.concat([pdf[keys].astype(object).iloc[flat.pop("_i")].reset_index(drop=True), flat], axis=1)

    return small.mapInPandas(whole, f"{columns}, piece string").unionByName(_split_ranges(big.filter(F.length(text_col) > RANGE), keys, limit, overlap, text_col, key_types, columns))


def _split_ranges(big: DataFrame, keys: list[str], limit: int, overlap: int, text_col: str, key_types: str, columns: str) -> DataFrame:
    """The same for items of several ranges."""

    def cut_ranges(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filter(len, it):
            for row in pdf.itertuples(index=False):
                text = row[-1]
                for at in range(0, len(text), RANGE):
                    part, a, b = range_at(text, at)
                    yield pd.DataFrame([(*row[:-1], len(text), at, part, a, b)], columns=[*keys, "_len", "_at", "_t", "_a", "_b"], dtype=object)

    ranges = big.select(*keys, text_col).mapInPandas(cut_ranges, f"{key_types}, _len long, _at long, _t string, _a int, _b int")

    def scan(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filter(len, it):
            tables = [boundaries(t, a, b) for t, a, b in zip(pdf["_t"], pdf["_a"], pdf["_b"])]
            offsets = [[at - a + o for o, _ in found] for found, at, a in zip(tables, pdf["_at"], pdf["_a"])]
            yield pdf[[*keys, "_len", "_at"]].astype(object).assign(_offsets=offsets, _strengths=[[s for _, s in found] for found in tables])

    spread = ranges.repartition(*keys, "_at")
    tables = spread.mapInPandas(scan, f"{key_types}, _len long, _at long, _offsets array<long>, _strengths array<int>")
    ordered = tables.repartition(*keys).sortWithinPartitions(*keys, "_at")
    pieces = ordered.mapInPandas(lambda it: _stitch(it, keys, "_len", "_at", "_offsets", "_strengths", limit, overlap), columns)

    # Each piece takes its parts from the ranges that it touches.
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    touched = pieces.withColumn("_at", F.explode(F.expr(f"transform(sequence(start_offset div {RANGE}, (end_offset - 1) div {RANGE}), k -> k * {RANGE})")))
    both = touched.alias("p").join(ranges.alias("r"), [*same, F.col("p._at") == F.col("r._at")])
    part = F.expr(f"substring(_t, cast(_a + greatest(start_offset - p._at, 0) + 1 as int), cast(least(end_offset, p._at + {RANGE}) - greatest(start_offset, p._at) as int))")
    own = [F.col(f"p.{k}").alias(k) for k in keys]
    parts = both.select(*own, "piece_no", "start_offset", "end_offset", "boundary", F.struct(F.col("p._at").alias("at"), part.alias("part")).alias("s"))
    joined = parts.groupBy(*keys, "piece_no", "start_offset", "end_offset", "boundary").agg(F.sort_array(F.collect_list("s")).alias("s"))
    return joined.select(*keys, "piece_no", "start_offset", "end_offset", "boundary", F.array_join(F.col("s.part"), "").alias("piece"))


def _stitch(it: Iterator[pd.DataFrame], keys: list[str], length: str, at: str, offsets: str, strengths: str, limit: int, overlap: int, span: str | None = None) -> Iterator[pd.DataFrame]:
    """Plans items whose boundary tables come in order; one item is open at a time. span: the column of the ranges' lengths, RANGE without one."""
    item, planner, number = None, None, 0
    for pdf in filter(len, it):
        out = []
        spans = pdf[span] if span else [RANGE] * len(pdf)
        for *key, n, start, o, s, size in zip(*(pdf[c] for c in (*keys, length, at, offsets, strengths)), spans):
            key = tuple(None if x is None or x != x else x for x in key)
            if planner is None or key != item:
                item, planner, number = key, Planner(int(n), limit, overlap), 0
            for a, b, strength in planner.feed(np.asarray(o, dtype="int64"), np.asarray(s, dtype="int64"), min(int(start) + int(size), int(n))):
                out.append((*key, number, a, b, KIND[strength]))
                number += 1
        if out:
            yield pd.DataFrame(out, columns=[*keys, "piece_no", "start_offset", "end_offset", "boundary"], dtype=object)


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else os.path.abspath(uri))


def _byte_ends(text: str) -> np.ndarray:
    """Bytes of the text's UTF-8 form up to each character's end, after a 0."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.concatenate([[0], np.cumsum(1 + (c > 0x7F).astype("int64") + (c > 0x7FF) + (c > 0xFFFF))])


def split_files(spark: SparkSession, paths: list[str], limit: int, overlap: int, range_bytes: int = 8 << 20, halo: int = 4096) -> DataFrame:
    """path, piece_no, start_offset, end_offset (bytes), boundary and piece of UTF-8 files of any size and file system.

    limit and overlap are bytes here. Workers read one byte range with its halo at a time; pieces are
    read by offset. Cuts never fall inside a character: those without a boundary go back to its start.
    White space that is longer than the halo may be cut inside.
    """
    sizes = []
    for p in paths:
        store, name = _opened(p)
        sizes.append((p, store.get_file_info(name).size))
    todo = [(p, n, at) for p, n in sizes for at in range(0, n, range_bytes)]
    ranges = spark.createDataFrame(todo, "path string, size long, start long")
    ranges = ranges.repartition(max(1, min(len(todo), 10_000)), "path", "start")
    room = limit - 3  # a cut may go back by up to three bytes, and so may the start after it

    def scan(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filter(len, it):
            for path, size, start in pdf.itertuples(index=False):
                store, name = _opened(path)
                with store.open_input_file(name) as f:
                    first = max(0, start - halo)
                    raw = f.read_at(min(size, start + range_bytes + halo) - first, first)
                skip = next((i for i in range(min(4, len(raw))) if raw[i] & 0xC0 != 0x80), 0)  # the rest of a character
                text = raw[skip:].decode("utf-8", "surrogateescape")
                ends = _byte_ends("".join("a" if "\udc80" <= c <= "\udcff" else c for c in text) if not text.isascii() else text)
                found = [(first + skip + int(ends[o]), s) for o, s in boundaries(text, 0, len(text))]
                inside = [(o, s) for o, s in found if start < o <= start + range_bytes]
                yield pd.DataFrame({"path": path, "size": size, "start": start, "offsets": [[o for o, _ in inside]], "strengths": [[s for _, s in inside]], "span": range_bytes})

    tables = ranges.mapInPandas(scan, "path string, size long, start long, offsets array<long>, strengths array<int>, span long")
    ordered = tables.repartition("path").sortWithinPartitions("path", "start")

    def stitched(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _stitch(it, ["path"], "size", "start", "offsets", "strengths", room, overlap, "span")

    pieces = ordered.mapInPandas(stitched, "path string, piece_no int, start_offset long, end_offset long, boundary string").repartition("path", "piece_no")

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filter(len, it):
            texts, starts, stops = [], [], []
            for path, a, b in zip(pdf["path"], pdf["start_offset"], pdf["end_offset"]):
                store, name = _opened(path)
                with store.open_input_file(name) as f:
                    raw, first = f.read_at(b - max(0, a - 3) + 1, max(0, a - 3)), max(0, a - 3)
                a, b = _character(raw, a - first), _character(raw, b - first)
                texts.append(raw[a:b].decode("utf-8", "replace"))
                starts.append(first + a)
                stops.append(first + b)
            yield pdf.assign(start_offset=starts, end_offset=stops, piece=texts)

    return pieces.mapInPandas(read, "path string, piece_no int, start_offset long, end_offset long, boundary string, piece string")


def _character(raw: bytes, at: int) -> int:
    """The start of the character that a place lies in."""
    while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
        at -= 1
    return at


def items_of(paragraphs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(item_kind, row_id, entry_no, text): the paragraphs' originals and the entries of the contexts before."""
    p = paragraphs.select(F.lit("paragraph").alias("item_kind"), "row_id", F.lit(0).alias("entry_no"), F.col("original_text").alias("text"))
    c = chunks.select(F.lit("context").alias("item_kind"), F.col("chunk_row_id").alias("row_id"), F.posexplode("context_before").alias("entry_no", "text"))
    return p.unionByName(c)


def limits(size_limits: DataFrame) -> dict[str, tuple[int, int]]:
    """item_kind -> (max_size, overlap_size); the table has one row for each of a fixed set of kinds."""
    return {r.item_kind: (r.max_size, r.overlap_size) for r in size_limits.collect()}


def split_by_limits(paragraphs: DataFrame, chunks: DataFrame, size_limits: DataFrame) -> DataFrame:
    """All pieces of all oversized items. Each repeated row is an item of its own: row ids are unique."""
    lim, items = limits(size_limits), items_of(paragraphs, chunks)
    keys = ["item_kind", "row_id", "entry_no"]
    parts = [split_items(items.filter(F.col("item_kind") == kind), keys, *lim[kind]) for kind in ("paragraph", "context")]
    return parts[0].unionByName(parts[1])


def found(paragraphs: DataFrame, chunks: DataFrame, size_limits: DataFrame) -> DataFrame:
    """The oversized items: those whose splitting has a first piece that is not the last."""
    pieces = split_by_limits(paragraphs, chunks, size_limits)
    return pieces.filter("piece_no = 0").select("item_kind", "row_id", "entry_no")


def fits(pieces: DataFrame, limit: int) -> DataFrame:
    """Pieces that break the limit or do not follow on their predecessor; empty where all is well."""
    w = Window.partitionBy("item_kind", "row_id", "entry_no").orderBy("piece_no")
    gap = F.coalesce(F.col("start_offset") > F.lag("end_offset").over(w), F.lit(False))
    return pieces.withColumn("_gap", gap).filter((F.col("end_offset") - F.col("start_offset") > limit) | F.col("_gap")).drop("_gap")
