"""Mixing sources to target weights (problem 9).

Sizes are tokens of a public tokenizer. Each source is permuted in blocks of documents (a seeded
hash decides both the block and the order inside it). A source's budget is its share of the
mix, at most ``max_repeats`` times its size; it is spent in whole passes over the source and
one partial pass that takes blocks in order and cuts the last block by a running sum. The
blocks of every source are distributed over the output shards by a multivariate-hypergeometric
splitting tree: each node splits the exact block quotas of its shards in two, so that every
shard gets disjoint blocks in the mix's proportions; the rows are then shuffled inside a shard.

Only block sums (sources x ``blocks``, a fixed number) reach the driver.

Defined results: sources are compared in lower case without outer blanks; documents without a
source of the targets, and with a null text, take no part; an empty text has no tokens and is
kept with its block; a source below its share after all repeats is reported as not reached. A
repeated target row counts once (the first by name); without targets the mix is empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import TRIM
from ..session import checkpointed
from .encode import DEFAULT_RANKS, token_counts


def source_key(col):
    return F.lower(F.regexp_replace(col, TRIM, ""))


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Blocks of each source for each shard: a node draws the left half's blocks without replacement."""
    if shards == 1:
        return [quotas]
    left = shards // 2
    total = int(quotas.sum())
    take = round(total * left / shards)
    drawn = rng.multivariate_hypergeometric(quotas, take) if total else np.zeros_like(quotas)
    return split_quotas(drawn, left, rng) + split_quotas(quotas - drawn, shards - left, rng)


def sized(documents: DataFrame, targets: DataFrame, ranks_path: str, blocks: int, seed: int) -> DataFrame:
    """doc_id, source, block, at (its place in the block), n_tokens of the documents of the targets' sources."""
    names = targets.select(source_key("source").alias("source")).distinct()
    docs = documents.select("doc_id", source_key("source").alias("source"), "text").filter(F.col("source").isNotNull() & F.col("text").isNotNull())
    docs = docs.join(F.broadcast(names), "source", "left_semi")  # one row a target: a fixed table
    h = F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64("text"))
    return docs.select("doc_id", "source", F.pmod(h, F.lit(blocks)).cast("int").alias("block"), F.xxhash64(F.lit(seed + 1), h).alias("at"), token_counts(ranks_path)("text").alias("n_tokens"))


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, shards: int = 16, blocks: int = 1024, seed: int = 42, ranks_path: str = DEFAULT_RANKS) -> tuple[DataFrame, DataFrame]:
    """(rows of the mix, report).

    Rows: shard, place, doc_id, source, repeat_no, n_tokens; ``place`` orders a shard's rows. The
    mix's size is ``total_tokens``, or that of all its sources together.
    """
    spark = documents.sparkSession
    want = {}
    for r in sorted(targets.select(source_key("source").alias("source"), "target_share", "max_repeats").collect(), key=lambda r: (str(r.source), r.target_share or 0)):
        if r.source is not None:
            want.setdefault(r.source, (r.target_share or 0.0, r.max_repeats or 0))
    docs = checkpointed(sized(documents, targets, ranks_path, blocks, seed))
    sums = docs.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")).collect()

    names = sorted(want)
    tokens = {s: np.zeros(blocks, dtype="int64") for s in names}
    present = {s: np.zeros(blocks, dtype=bool) for s in names}
    for r in sums:
        tokens[r.source][r.block], present[r.source][r.block] = r.tokens, True
    have = {s: int(tokens[s].sum()) for s in names}
    planned = sum(have.values()) if total_tokens is None else total_tokens

    rng = np.random.default_rng(seed)
    takes = []  # (source, block, repeat_no, budget inside the block or None for all)
    for s in names:
        share, cap = want[s]
        budget = min(round(share * planned), cap * have[s])
        order = [int(b) for b in rng.permutation(blocks) if present[s][b]]
        passes, rest = divmod(budget, have[s]) if have[s] else (0, 0)
        takes += [(s, b, k, None) for k in range(passes) for b in order]
        for b in order:
            if rest <= 0:
                break
            takes.append((s, b, passes, None if tokens[s][b] <= rest else int(rest)))
            rest -= int(tokens[s][b])

    # The tree: how many block copies of each source each shard gets; then disjoint permuted blocks.
    quotas = np.array([sum(1 for t in takes if t[0] == s) for s in names], dtype="int64")
    tree = split_quotas(quotas, shards, rng)
    where = []
    for i, s in enumerate(names):
        own = [t for t in takes if t[0] == s]
        rng.shuffle(own)
        shard_of = [k for k, q in enumerate(tree) for _ in range(int(q[i]))]
        where += [(*t, k) for t, k in zip(own, shard_of)]
    plan = spark.createDataFrame(where, "source string, block int, repeat_no int, budget long, shard int")  # at most sources x blocks x repeats rows

    joined = docs.join(F.broadcast(plan.filter("budget is null").drop("budget")), ["source", "block"]).select("shard", "doc_id", "source", "repeat_no", "n_tokens", "at")
    edge = docs.join(F.broadcast(plan.filter("budget is not null")), ["source", "block"])  # one block a source
    run = Window.partitionBy("source", "block", "repeat_no").orderBy("at", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("_sum", F.sum("n_tokens").over(run)).filter(F.col("_sum") <= F.col("budget")).select("shard", "doc_id", "source", "repeat_no", "n_tokens", "at")
    rows = joined.unionByName(edge).select("shard", F.xxhash64(F.lit(seed + 2), "repeat_no", "at").alias("place"), "doc_id", "source", "repeat_no", "n_tokens")

    goal = spark.createDataFrame([(s, float(want[s][0]), int(want[s][1]), have[s]) for s in names] or [], "source string, target_share double, max_repeats int, source_tokens long")
    used = rows.groupBy("source").agg(F.sum("n_tokens").alias("mix_tokens"), F.count("*").alias("mix_rows"), (F.max("repeat_no") + 1).alias("most_uses"))
    total = Window.partitionBy(F.lit(1))  # over one row a target
    report = goal.join(used, "source", "left").na.fill(0, ["mix_tokens", "mix_rows", "most_uses"])
    report = report.withColumn("actual_share", F.col("mix_tokens") / F.sum("mix_tokens").over(total)).withColumn("planned_tokens", F.round(F.col("target_share") * F.lit(planned)).cast("long"))
    report = report.withColumn("reached", F.col("max_repeats") * F.col("source_tokens") >= F.col("planned_tokens"))
    return rows, report


def write_shards(rows: DataFrame, path: str) -> None:
    """One folder a shard, shuffled inside: a sort by place within the shard's partition."""
    rows.repartition("shard").sortWithinPartitions("shard", "place").write.mode("overwrite").partitionBy("shard").parquet(path)
