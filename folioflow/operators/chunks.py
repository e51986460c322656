"""Translation chunks: greedy packing, context, prompts, and parsing of replies."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import effective, strip, word_count

CHAPTER = ["project_id", "chapter_id"]


def _walk(sizes: list[int], words: int, n: int, target: int, most: int, known: dict[int, tuple[int, int]] | None = None) -> tuple[list[int], int]:
    """(places where chunks start, rows of the open chunk at the end) from a state of words and rows.

    known maps a place where the walk from the empty state starts a chunk to (its rank, 0): from
    there on both walks are one, so this one stops.
    """
    starts = []
    for i, x in enumerate(sizes):
        if n == 0 or words + x > target or n >= most:
            if known is not None and i in known:
                return starts, -1 - i
            starts.append(i)
            words, n = 0, 0
        words, n = words + x, n + 1
    return starts, n


def _block_maps(sizes: list[int], halo: list[int], target: int, most: int) -> tuple[list[int], list[int]]:
    """For each number of rows that the open chunk may bring in: rows it takes out, chunks started."""
    base, end = _walk(sizes, 0, 0, target, most)
    rank = {p: (k, 0) for k, p in enumerate(base)}
    outs, counts = [end % most], [len(base)]
    for n in range(1, len(halo) + 1):
        starts, at = _walk(sizes, sum(halo[-n:]), n, target, most, rank)
        if at < 0:
            outs.append(outs[0])
            counts.append(len(starts) + len(base) - rank[-1 - at][0])
        else:
            outs.append(at % most)
            counts.append(len(starts))
    return outs, counts


def greedy_chunks(rows: DataFrame, target_words: int = 1000, max_rows: int = 12, block: int = 4096) -> DataFrame:
    """project_id, chapter_id, para_id, para_index, n_words, chunk_no of the rows in reading order.

    A chunk closes before a row that would exceed the words or the rows; a row above the words
    is a chunk by itself.

    The state at a row depends on all rows before, but a block of rows sees of it only how many
    rows the open chunk brings in, fewer than ``max_rows``. So each block of a chapter is walked
    by itself from each such state (walks soon meet and then are one), the blocks' small maps are
    chained per chapter, and each block numbers its rows from its true state. No task holds more
    than a block of rows, however long a chapter is.
    """
    base = rows.select(*CHAPTER, "para_index", "para_id", word_count(F.col("original_text")).alias("n_words"))
    base = base.withColumn("_b", F.floor(F.coalesce("para_index", F.lit(0)) / block))
    items = base.groupBy(*CHAPTER, "_b").agg(F.sort_array(F.collect_list(F.struct("para_index", "para_id", "n_words"))).alias("_items"))
    sizes = items.select(*CHAPTER, "_b", F.col("_items.n_words").alias("_sizes"))

    w = Window.partitionBy(*CHAPTER).orderBy("_b")
    keep = max(max_rows - 1, 1)
    tail = sizes.withColumn("_tail", F.expr(f"slice(_sizes, greatest(size(_sizes) - {keep} + 1, 1), {keep})"))
    before = F.flatten(F.collect_list("_tail").over(w.rowsBetween(-keep, -1)))
    tail = tail.withColumn("_halo", before).withColumn("_many", F.lead("_b").over(w).isNotNull() | F.lag("_b").over(w).isNotNull()).filter("_many")
    tail = tail.withColumn("_halo", F.expr(f"slice(_halo, greatest(size(_halo) - {keep} + 1, 1), {keep})")) if max_rows > 1 else tail.withColumn("_halo", F.array().cast("array<long>"))

    def maps(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filter(len, it):
            done = [_block_maps([int(x) for x in s], [int(x) for x in h], target_words, max_rows) for s, h in zip(pdf["_sizes"], pdf["_halo"])]
            yield pdf[[*CHAPTER, "_b"]].astype(object).assign(_outs=[d[0] for d in done], _starts=[d[1] for d in done])

    table = tail.select(*CHAPTER, "_b", "_sizes", "_halo").mapInPandas(maps, "project_id string, chapter_id string, _b long, _outs array<int>, _starts array<int>")
    chained = table.groupBy(*CHAPTER).agg(F.sort_array(F.collect_list(F.struct("_b", "_outs", "_starts"))).alias("_t"))

    def chain(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filter(len, it):
            out = []
            for p, c, blocks in zip(pdf["project_id"], pdf["chapter_id"], pdf["_t"]):
                n = made = 0
                for x in blocks:
                    out.append((p, c, x["_b"], n, made))
                    made += int(x["_starts"][n])
                    n = int(x["_outs"][n])
            yield pd.DataFrame(out, columns=[*CHAPTER, "_b", "_n", "_made"])

    entry = chained.mapInPandas(chain, "project_id string, chapter_id string, _b long, _n int, _made long")
    halos = tail.select(*CHAPTER, "_b", "_halo")
    entry = entry.join(halos, [*CHAPTER, "_b"])
    state = items.join(entry, [*CHAPTER, "_b"], "left").select(*CHAPTER, "_items", F.coalesce("_n", F.lit(0)).alias("_n"), F.coalesce("_made", F.lit(0).cast("long")).alias("_made"), F.coalesce("_halo", F.array().cast("array<long>")).alias("_halo"))

    def number(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filter(len, it):
            numbers = []
            for rows_, n, made, halo in zip(pdf["_items"], pdf["_n"], pdf["_made"], pdf["_halo"]):
                words = [int(x["n_words"]) for x in rows_]
                starts, _ = _walk(words, sum(int(x) for x in halo[len(halo) - n :]) if n else 0, n, target_words, max_rows)
                begins, k, own = set(starts), int(made) - 1, []
                for i in range(len(words)):
                    k += i in begins
                    own.append(k)
                numbers.append(own)
            yield pdf[[*CHAPTER, "_items"]].astype(object).assign(_numbers=numbers)

    item = "array<struct<para_index:int,para_id:string,n_words:bigint>>"
    flat = state.mapInPandas(number, f"project_id string, chapter_id string, _items {item}, _numbers array<long>").select(*CHAPTER, F.explode(F.arrays_zip("_items", "_numbers")).alias("_z"))
    return flat.select(*CHAPTER, F.col("_z._items.para_id").alias("para_id"), F.col("_z._items.para_index").alias("para_index"), F.col("_z._items.n_words").alias("n_words"), F.col("_z._numbers").alias("chunk_no"))


def contexts(paragraphs: DataFrame, size: int = 3) -> DataFrame:
    """For each row the effective texts of up to ``size`` rows of any kind right before it."""
    w = Window.partitionBy(*CHAPTER).orderBy("para_index", "para_id").rowsBetween(-size, -1)
    shown = effective(F.col("translated_text"), F.coalesce("original_text", F.lit("")))
    return paragraphs.select(*CHAPTER, "para_id", F.collect_list(shown).over(w).alias("context"))


def chunk_plan(chunks: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """One row a chunk: first row, rows, words, and the context before it."""
    per = chunks.groupBy(*CHAPTER, "chunk_no").agg(F.min_by("para_id", F.struct("para_index", "para_id")).alias("first_para"), F.count("*").alias("n_rows"), F.sum("n_words").alias("n_words"))
    ctx = contexts(paragraphs).withColumnRenamed("para_id", "first_para")
    return per.join(ctx, [*CHAPTER, "first_para"]).select(*CHAPTER, "chunk_no", "first_para", "n_rows", "n_words", F.array_join("context", "\n").alias("context_text"))


def prompt_body(chunks: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """The marked rows of each chunk as they go to a model."""
    text = paragraphs.select(*CHAPTER, "para_id", F.coalesce("original_text", F.lit("")).alias("t"))
    rows = chunks.join(text, [*CHAPTER, "para_id"])
    piece = F.concat(F.lit("[[[P_"), "para_id", F.lit("]]]\n"), "t")
    s = F.struct("para_index", "para_id", piece.alias("piece"))
    return rows.groupBy(*CHAPTER, "chunk_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(s)), lambda x: x["piece"]), "\n\n").alias("prompt"))


def parse_reply(keys: list[str], replies: DataFrame) -> DataFrame:
    """keys, para_id, text of the marked parts of replies (column reply); the last non-blank part of an id wins."""
    parts = F.posexplode(F.slice(F.split("reply", r"\[\[\[P_", -1), 2, 1_000_000)).alias("pos", "part")
    rows = replies.select(*keys, parts)
    ident = F.regexp_extract("part", r"^([^\]]*)\]\]\]", 1)
    body = strip(F.regexp_replace("part", r"^[^\]]*\]\]\]", ""))
    rows = rows.select(*keys, "pos", ident.alias("para_id"), body.alias("text")).filter("para_id != '' and text != ''")
    return rows.groupBy(*keys, "para_id").agg(F.max_by("text", "pos").alias("text"))


def fallback_reply(keys: list[str], replies: DataFrame, expected: DataFrame) -> DataFrame:
    """Blocks of unmarked replies put on the expected ids by position, if there are as many of either.

    expected: keys, para_id, pos (from 0).
    """
    blocks = F.filter(F.transform(F.split("reply", r"\n\s*\n", -1), lambda b: strip(F.regexp_replace(b, r"\[\[\[P_[^\]]*\]\]\]", ""))), lambda b: b != "")
    rows = replies.select(*keys, blocks.alias("_b"))
    count = expected.groupBy(*keys).agg(F.count("*").alias("_n"))
    rows = rows.join(count, keys).filter(F.size("_b") == F.col("_n")).select(*keys, F.posexplode("_b").alias("pos", "text"))
    return rows.join(expected.withColumn("pos", F.col("pos").cast("int")), [*keys, "pos"]).select(*keys, "para_id", "text")


def resolved_replies(keys: list[str], replies: DataFrame, expected: DataFrame) -> DataFrame:
    """Marked parts first; where a reply has fewer parts than expected, unmarked blocks fill only the missing ids."""
    marked = parse_reply(keys, replies)
    found = marked.groupBy(*keys).agg(F.count("*").alias("_found"))
    want = expected.groupBy(*keys).agg(F.count("*").alias("_want"))
    short = replies.join(want, keys).join(found, keys, "left").filter(F.coalesce("_found", F.lit(0)) < F.col("_want")).select(*replies.columns)
    fill = fallback_reply(keys, short, expected).join(marked, [*keys, "para_id"], "left_anti")
    return marked.withColumn("method", F.lit("marker")).unionByName(fill.withColumn("method", F.lit("position"))).join(expected.select(*keys, "para_id"), [*keys, "para_id"], "left_semi")


#: Headings of the parts of a request; fixed values.
CONTEXT_HEADING = "=== NGỮ CẢNH CÁC ĐOẠN LIỀN TRƯỚC (ĐỂ LIỀN MẠCH CẢM XÚC VÀ XƯNG HÔ) ==="
ROWS_HEADING = "=== CÁC ĐOẠN CẦN DỊCH (HÃY DỊCH TỪNG ĐOẠN VÀ GIỮ MÃ ĐÁNH DẤU [[[P_id]]]) ==="


def glossary_block(style: Column, characters: Column, terms: Column, custom: Column) -> Column:
    """Parts of the style sheet that are not empty, a line each."""
    return F.concat_ws("\n", style, F.nullif(characters, F.lit("")), F.nullif(terms, F.lit("")), F.nullif(custom, F.lit("")))


def requests(prompts: DataFrame, plan: DataFrame, glossaries: DataFrame) -> DataFrame:
    """The whole request of each chunk: glossary, context before it (if there is any), marked rows.

    prompts: keys, prompt; plan: keys, context_text; glossaries: project_id, block.
    """
    keys = [*CHAPTER, "chunk_no"]
    rows = prompts.join(plan.select(*keys, "context_text"), keys).join(glossaries.select("project_id", "block"), "project_id", "left")
    context = F.when(F.coalesce("context_text", F.lit("")) != "", F.concat(F.lit(CONTEXT_HEADING + "\n"), "context_text", F.lit("\n\n"))).otherwise("")
    return rows.select(*keys, F.concat(F.coalesce("block", F.lit("")), F.lit("\n\n"), context, F.lit(ROWS_HEADING + "\n"), "prompt").alias("request"))
