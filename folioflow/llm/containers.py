"""Filling containers of fixed capacity with items (problem 5).

The global histogram of item sizes (at most ``capacity`` bins) gives, by dynamic programming,
the bucket boundaries that minimise padding. Inside each bucket of a group, items form full
batches under the capacity; what is left over of all buckets then fills the gaps, largest
first, each into the fullest batch that still has room for it. An item above the capacity is
cut into parts of at most the capacity; nothing else is split.

A group of any size is spread over blocks of about ``block`` rows by a hash of the item's id, so
that no task holds a hot group; each block wastes at most the room of its last batch.

Defined results: null or blank texts have size 0 and go where the group's first batch is; ties
are ordered by id; every input row, repeated ones too, appears once (or once for each part).
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import BLANK


def words(col: Column) -> Column:
    """Number of words separated by white space; 0 for null and blank."""
    spaces = F.regexp_replace(F.coalesce(col.cast("string"), F.lit("")), f"{BLANK}+", " ")
    trimmed = F.trim(spaces)
    return F.when(trimmed == "", F.lit(0)).otherwise(F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1)


def bucket_bounds(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets that minimise the sum of (bound - size) over all items."""
    sizes = np.array(sorted(s for s, n in histogram.items() if n > 0), dtype="int64")
    if not len(sizes):
        return []
    counts = np.array([histogram[int(s)] for s in sizes], dtype="float64")
    n, k = len(sizes), min(buckets, len(sizes))
    cum, mass = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * sizes)])
    best = np.full((k + 1, n + 1), np.inf)
    best[0, 0] = 0
    back = np.zeros((k + 1, n + 1), dtype="int64")
    for b in range(1, k + 1):
        for j in range(1, n + 1):
            cost = best[b - 1, :j] + sizes[j - 1] * (cum[j] - cum[:j]) - (mass[j] - mass[:j])
            i = int(np.argmin(cost))
            best[b, j], back[b, j] = cost[i], i
    out, j = [], n
    for b in range(int(np.argmin(best[:, n])), 0, -1):
        out.append(int(sizes[j - 1]))
        j = int(back[b, j])
    return out[::-1]


def pack(sizes: list[int], capacity: int, bounds: list[int]) -> list[int]:
    """Batch number of each item: full batches by bucket, then the rest into the gaps."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    batch = [-1] * len(sizes)
    rooms: list[tuple[int, int]] = []  # (room, batch), sorted
    left: list[int] = []
    made = 0
    at = 0
    lower = [0, *bounds]
    for top in range(len(bounds), 0, -1):
        members = []
        while at < len(order) and sizes[order[at]] > lower[top - 1]:
            members.append(order[at])
            at += 1
        start, load = 0, 0
        for i, m in enumerate(members):
            if load + sizes[m] > capacity:
                for x in members[start:i]:
                    batch[x] = made
                insort(rooms, (capacity - load, made))
                made += 1
                start, load = i, 0
            load += sizes[m]
        left += members[start:]
    left += order[at:]  # empty items
    left.sort(key=lambda i: (-sizes[i], i))
    for i in left:
        k = bisect_left(rooms, (sizes[i], -1))
        if k < len(rooms):
            room, b = rooms.pop(k)
        else:
            room, b = capacity, made
            made += 1
        batch[i] = b
        insort(rooms, (room - sizes[i], b))
    return batch


def fill(items: DataFrame, group: list[str], id_col: str, size_col: str, capacity: int, buckets: int = 8, block: int = 2048) -> DataFrame:
    """group, block, batch_no, id, part_no, size of each item (or part of an oversized one)."""
    base = items.select(*group, F.col(id_col).alias("_id"), F.col(size_col).cast("int").alias("_size"))
    whole = F.array(F.struct(F.lit(0).alias("part_no"), F.col("_size").alias("size")))
    parts = F.transform(
        F.sequence(F.lit(0), F.ceil(F.col("_size") / F.lit(capacity)).cast("int") - 1),
        lambda k: F.struct(k.alias("part_no"), F.least(F.lit(capacity), F.col("_size") - k * F.lit(capacity)).alias("size")),
    )
    each = base.withColumn("_p", F.explode(F.when(F.col("_size") > capacity, parts).otherwise(whole))).select(*group, "_id", "_p.part_no", "_p.size")

    counted = each.groupBy("size").count().collect()  # at most capacity + 1 rows
    bounds = bucket_bounds({r["size"]: r["count"] for r in counted if r["size"]}, buckets)

    # Only groups above the block size are looked up: there are at most rows / block of them.
    hot = base.groupBy(*group).count().filter(F.col("count") > block).select(*[F.col(g).alias(f"_h{i}") for i, g in enumerate(group)], F.ceil(F.col("count") / block).cast("int").alias("_n"))
    same = [each[g].eqNullSafe(hot[f"_h{i}"]) for i, g in enumerate(group)]
    placed = each.join(hot, same, "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("_id"), F.col("_n")).cast("int"), F.lit(0)))
    grouped = placed.groupBy(*group, "block").agg(F.sort_array(F.collect_list(F.struct("_id", "part_no", "size"))).alias("_items"))
    grouped = grouped.select(*group, "block", F.col("_items._id").alias("_ids"), F.col("_items.part_no").alias("_parts"), F.col("_items.size").alias("_sizes"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in each.schema if f.name in group)
    id_type = each.schema["_id"].dataType.simpleString()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filter(len, it):
            done = [pack([int(x) for x in s], capacity, bounds) for s in pdf["_sizes"]]
            yield pdf.astype(object).assign(_batches=done)

    packed = grouped.mapInPandas(run, f"{types}, block int, _ids array<{id_type}>, _parts array<int>, _sizes array<int>, _batches array<int>")
    flat = packed.select(*group, "block", F.explode(F.arrays_zip("_ids", "_parts", "_sizes", "_batches")).alias("_z"))
    return flat.select(*group, "block", F.col("_z._batches").alias("batch_no"), F.col("_z._ids").alias(id_col), F.col("_z._parts").alias("part_no"), F.col("_z._sizes").alias("size"))


def chunk_chapters(paragraphs: DataFrame, size_limits: DataFrame) -> DataFrame:
    """Containers of the non-image paragraphs of each chapter, sized by original_text in words."""
    row = size_limits.filter("item_kind = 'chunk'").collect()[0]
    text = F.col("original_text")
    size = words(text) if row.size_unit == "words" else F.coalesce(F.length(text), F.lit(0))
    items = paragraphs.filter(F.coalesce(F.col("tag") != "img", F.lit(True))).select("project_id", "chapter_id", "row_id", size.alias("n_words"))
    out = fill(items, ["project_id", "chapter_id"], "row_id", "n_words", row.max_size)
    return out.select("project_id", "chapter_id", "block", "batch_no", "row_id", "part_no", F.col("size").alias("n_words"))


def fill_report(chunks: DataFrame, capacity: int) -> DataFrame:
    """Per project: containers, words, and the share of unused room beside the least possible one."""
    per = chunks.groupBy("project_id", "chapter_id", "block", "batch_no").agg(F.sum("n_words").alias("load"))
    chapter = per.groupBy("project_id", "chapter_id").agg(F.count("*").alias("n"), F.sum("load").alias("words"))
    least = F.greatest(F.lit(1), F.ceil(F.col("words") / capacity))
    return chapter.groupBy("project_id").agg(F.sum("n").alias("containers"), F.sum("words").alias("words"), F.sum(least).alias("least_containers")).withColumn("unused_share", F.round(1 - F.col("words") / (F.col("containers") * capacity), 4))
