"""Operators over the contents of EPUB files: spine, table of contents, elements.

toc: doc_id, toc_pos, parent_pos, depth, title, path, fragment. spine: doc_id, spine_pos, path, linear, is_nav.
elements: doc_id, path, el_pos, anchor, text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpointed

GROUP_TITLE = r"(?iu)^(?:part|book|volume|phần|quyển)\b"


def unquoted(c):
    """URL-decoded; a plus is itself, and what is no valid code stays."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def normal_path(c):
    """URL-decoded, forward slashes, no dot segments, case kept."""
    return dot_free(F.replace(unquoted(c), F.lit("\\"), F.lit("/")))


def dot_free(p):
    """A path without empty and dot segments; leading ``..`` that nothing stands before stay."""
    parts = F.filter(F.split(p, "/"), lambda s: (s != "") & (s != "."))
    up = F.lit("..")
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda a, s: F.when((s == up) & (F.size(a) > 0) & (F.coalesce(F.try_element_at(a, F.lit(-1)), up) != up), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))))
    return F.array_join(folded, "/")


def href_parts(hrefs: DataFrame) -> DataFrame:
    """href -> path, fragment; both URL-decoded."""
    whole = hrefs.withColumn("_h", F.replace(unquoted(F.col("href")), F.lit("\\"), F.lit("/")))
    return whole.select("href", dot_free(F.split_part("_h", F.lit("#"), F.lit(1))).alias("path"), F.regexp_replace("_h", "^[^#]*#?", "").alias("fragment"))


def reading_spine(spine: DataFrame) -> DataFrame:
    """Spine items to read: present, linear, no navigation; renumbered."""
    kept = spine.filter(F.col("path").isNotNull() & (F.coalesce("linear", F.lit("yes")) != "no") & ~F.coalesce("is_nav", F.lit(False)))
    return kept.withColumn("spine_idx", (F.row_number().over(Window.partitionBy("doc_id").orderBy("spine_pos")) - 1).cast("long"))


def promoted(toc: DataFrame, depth: int = 8) -> DataFrame:
    """The entries that open chapters: the shallowest ones, where pure grouping nodes give way to their children.

    Each level is one join with the children, down to the last grouping node; lineage is cut each ``depth`` levels.
    """
    first = toc.groupBy("doc_id", F.col("parent_pos").alias("toc_pos")).agg(F.min_by("path", "toc_pos").alias("child_path"), F.count("*").alias("children"))
    nodes = toc.join(first, ["doc_id", "toc_pos"], "left")
    bare = F.coalesce("path", F.lit("")).isin("", ".")
    grouping = F.coalesce("children", F.lit(0)) > 0
    grouping &= bare | (F.col("title").rlike(GROUP_TITLE) & (F.coalesce("child_path", F.lit("")) != "") & (F.col("path") == F.col("child_path")))
    nodes = nodes.withColumn("grouping", F.coalesce(grouping, F.lit(False)))
    level = nodes.filter("parent_pos is null")
    out = None
    while True:
        for _ in range(depth):
            keep = level.filter(~F.col("grouping"))
            out = keep if out is None else out.unionByName(keep)
            parents = level.filter("grouping").select("doc_id", F.col("toc_pos").alias("parent_pos"))
            level = nodes.join(parents, ["doc_id", "parent_pos"], "left_semi")
        level = checkpointed(level)
        if level.isEmpty():
            break
        out = checkpointed(out)
    return out.select("doc_id", "toc_pos", "title", "path", "fragment")


def resolved(entries: DataFrame, spine: DataFrame) -> DataFrame:
    """The spine item of each entry: equal path, else the only item of the same base name, else the path without dot segments; else none."""
    s = spine.select("doc_id", "spine_idx", "path", F.element_at(F.split("path", "/"), -1).alias("base"))
    exact = s.select("doc_id", "path", F.col("spine_idx").alias("exact_idx"))
    plain = s.select("doc_id", F.col("path").alias("plain"), F.col("spine_idx").alias("plain_idx"))
    only = s.groupBy("doc_id", "base").agg(F.count("*").alias("n"), F.min("spine_idx").alias("base_idx")).filter("n = 1").drop("n")
    path = F.coalesce("path", F.lit(""))
    e = entries.withColumn("base", F.element_at(F.split(path, "/"), -1)).withColumn("plain", dot_free(path))
    out = e.join(exact, ["doc_id", "path"], "left").join(only, ["doc_id", "base"], "left").join(plain, ["doc_id", "plain"], "left")
    return out.select("doc_id", "toc_pos", "title", "path", "fragment", F.coalesce("exact_idx", "base_idx", "plain_idx").alias("spine_idx"))


def flattened(toc: DataFrame) -> DataFrame:
    """doc_id, toc_pos, depth, title, place: all entries of the tree in reading order; levels are joined until none is left."""
    level = toc.filter("parent_pos is null").select("doc_id", "toc_pos", "title", F.lit(0).alias("depth"), F.array(F.col("toc_pos")).alias("way"))
    out = level
    while True:
        up = level.select("doc_id", F.col("toc_pos").alias("parent_pos"), F.col("depth").alias("_d"), F.col("way").alias("_w"))
        level = checkpointed(toc.join(up, ["doc_id", "parent_pos"]).select("doc_id", "toc_pos", "title", (F.col("_d") + 1).alias("depth"), F.concat("_w", F.array(F.col("toc_pos"))).alias("way")))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("way"))
    return out.select("doc_id", "toc_pos", "title", "depth", place.cast("long").alias("place"))


def intervals(starts: DataFrame) -> DataFrame:
    """Each start with the place before which its chapter ends: the next start of its document, or none."""
    w = Window.partitionBy("doc_id").orderBy("spine_idx", "el_pos")
    return starts.select("doc_id", "toc_pos", "title", "spine_idx", "el_pos", F.lead("spine_idx").over(w).alias("end_spine_idx"), F.lead("el_pos").over(w).alias("end_el_pos"))


def covers(assets: DataFrame) -> DataFrame:
    """The cover of each document: its first image whose name has cover or front. assets: doc_id, pos, name, is_image."""
    named = assets.filter(F.col("is_image") & (F.lower("name").contains("cover") | F.lower("name").contains("front")))
    return named.groupBy("doc_id").agg(F.min_by("name", "pos").alias("cover"))


def suffix_matches(members: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, member, name: the document of each member of an archive, by equal name or the longest suffix after a slash.

    The suffixes of a member's path are its keys: an equi-join, no comparison of all pairs.
    """
    parts = F.split("member", "/")
    keys = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    each = members.select("doc_id", "member", F.posexplode(keys).alias("skip", "name"))
    return each.join(docs, ["doc_id", "name"]).groupBy("doc_id", "member").agg(F.min_by("name", "skip").alias("name"))


def anchored(entries: DataFrame, spine: DataFrame, elements: DataFrame) -> DataFrame:
    """The first element with text at or after an entry's anchor; 0 where there is no such anchor. Equal places keep the first entry."""
    el = elements.join(spine.select("doc_id", "path", "spine_idx"), ["doc_id", "path"])
    anchors = el.filter("anchor is not null").groupBy("doc_id", "spine_idx", F.col("anchor").alias("fragment")).agg(F.min("el_pos").alias("anchor_pos"))
    e = entries.filter("spine_idx is not null").join(anchors, ["doc_id", "spine_idx", "fragment"], "left")
    texts = el.filter(F.coalesce(F.trim("text"), F.lit("")) != "").select("doc_id", "spine_idx", F.col("el_pos").alias("text_pos"))
    after = e.join(texts, ["doc_id", "spine_idx"], "left").groupBy("doc_id", "toc_pos", "title", "spine_idx").agg(F.min(F.when(F.col("text_pos") >= F.col("anchor_pos"), F.col("text_pos"))).alias("el"))
    starts = after.select("doc_id", "toc_pos", "title", "spine_idx", F.coalesce("el", F.lit(0)).cast("int").alias("el_pos"))
    rn = F.row_number().over(Window.partitionBy("doc_id", "spine_idx", "el_pos").orderBy("toc_pos"))
    return starts.withColumn("_rn", rn).filter("_rn = 1").drop("_rn")


def assigned(starts: DataFrame, spine: DataFrame, elements: DataFrame) -> DataFrame:
    """The chapter of each element: the last start at or before it in its document, else Preamble."""
    el = elements.join(spine.select("doc_id", "path", "spine_idx"), ["doc_id", "path"]).select("doc_id", "spine_idx", "el_pos", F.lit(None).cast("string").alias("start"), F.lit(1).alias("kind"), "text")
    st = starts.select("doc_id", "spine_idx", "el_pos", F.col("title").alias("start"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("text"))
    w = Window.partitionBy("doc_id").orderBy("spine_idx", "el_pos", "kind")
    both = st.unionByName(el).withColumn("chapter", F.coalesce(F.last("start", ignorenulls=True).over(w), F.lit("Preamble")))
    return both.filter("kind = 1").select("doc_id", "spine_idx", "el_pos", "chapter", "text")
