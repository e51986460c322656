"""The pN_ queries, run by production parameters over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import TRIM
from ..session import table
from . import align, bitext, broken, containers, defects, encode, mixing, normalize, pieces, scans, subjects

Query = Callable[[SparkSession, str], DataFrame]


def _p1(spark, d):
    return table(spark, d, "paragraphs"), table(spark, d, "chunks"), table(spark, d, "size_limits")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.found(*_p1(spark, d))


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split_by_limits(*_p1(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return broken.found(table(spark, d, "paragraphs"), table(spark, d, "documents"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return broken.report(table(spark, d, "paragraphs"), table(spark, d, "documents"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    paragraphs = table(spark, d, "paragraphs")
    return align.found(paragraphs, bitext.learn(paragraphs))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return defects.found(table(spark, d, "paragraphs"), table(spark, d, "documents"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return defects.report(table(spark, d, "paragraphs"), table(spark, d, "documents"))


def p5_chunks(spark: SparkSession, d: str) -> DataFrame:
    return containers.chunk_chapters(table(spark, d, "paragraphs"), table(spark, d, "size_limits"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    capacity = pieces.limits(table(spark, d, "size_limits"))["chunk"][0]
    return containers.fill_report(p5_chunks(spark, d), capacity)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    p = normalize.disguised_values(table(spark, d, "paragraphs"), "paragraph", "row_id", ["original_text", "translated_text"])
    c = normalize.disguised_values(table(spark, d, "chapters"), "chapter", "chapter_row_id", ["title"])
    return p.unionByName(c).select("record_kind", "record_id", "field_name")


def p6_normalized(spark: SparkSession, d: str) -> DataFrame:
    p = normalize.normalize_values(table(spark, d, "paragraphs"), "paragraph", "row_id", ["original_text", "translated_text"])
    return p.unionByName(normalize.normalize_values(table(spark, d, "chapters"), "chapter", "chapter_row_id", ["title"]))


def _p7(spark, d):
    return table(spark, d, "paragraphs"), table(spark, d, "chapters"), table(spark, d, "projects")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.found(*_p7(spark, d))


def p7_pages(spark: SparkSession, d: str) -> DataFrame:
    return scans.repair_books(*_p7(spark, d))[0]


def p7_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return scans.continuous(scans.repair_books(*_p7(spark, d))[0])


def p7_titles(spark: SparkSession, d: str) -> DataFrame:
    return scans.repair_books(*_p7(spark, d))[1]


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(table(spark, d, "documents"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """doc_id and the text that the ids decode to: the round trip."""
    return encode.decode(encode.encode(table(spark, d, "documents"))).drop("ids")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def _p10(spark, d):
    return table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subject_areas")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.found(*_p10(spark, d))


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    return subjects.composition(*_p10(spark, d))


def queries() -> dict[str, Query]:
    found = [p1_found, p1_pieces, p2_found, p2_report, p3_found, p4_found, p4_report, p5_chunks, p5_report, p6_found, p6_normalized, p7_found, p7_pages, p7_paragraphs, p7_titles, p8_ids, p8_decoded, p9_mix, p9_report, p10_found, p10_composition]
    return {f.__name__: f for f in found}



SQL = {
    "p1_found": f"""
WITH items AS (
  SELECT 'paragraph' AS item_kind, row_id, 0 AS entry_no, original_text AS t FROM paragraphs
  UNION ALL
  SELECT 'context', chunk_row_id, (n - 1)::INTEGER, context_before[n]
  FROM (SELECT chunk_row_id, context_before, unnest(range(1, len(context_before) + 1)) AS n FROM chunks))
SELECT item_kind, row_id, entry_no::INTEGER AS entry_no FROM items JOIN size_limits USING (item_kind)
WHERE length(regexp_replace(t, '{TRIM}', '', 'g')) > max_size""",
    "p6_found": f"""
WITH v AS (
  SELECT 'paragraph' AS record_kind, row_id AS record_id, 'original_text' AS field_name, original_text AS t FROM paragraphs
  UNION ALL SELECT 'paragraph', row_id, 'translated_text', translated_text FROM paragraphs
  UNION ALL SELECT 'chapter', chapter_row_id, 'title', title FROM chapters),
w AS (SELECT *, regexp_replace(t, '[{normalize.ZERO_WIDTH}]', '', 'g') AS bare FROM v)
SELECT record_kind, record_id, field_name FROM w
WHERE regexp_matches(t, '[{normalize._FULL}{normalize.ZERO_WIDTH}{normalize.NO_BREAK}]')
   OR regexp_matches(bare, '\\p{{L}}[{normalize._MARK}]')
   OR len(list_filter(regexp_extract_all(bare, '[\\p{{L}}{normalize._MARK}]+'), lambda x:
        regexp_matches(x, '[{normalize._ALIKE}]') AND regexp_matches(x, '[A-Za-zÀ-ɏḀ-ỿ]')
        AND NOT regexp_matches(regexp_replace(x, '[{normalize._ALIKE}]', '', 'g'), '[{normalize._OTHER}]'))) > 0""",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
