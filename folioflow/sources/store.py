"""Project stores of JSON files: explicit schemas, defaults for fields that old files lack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

META = "id string, title string, author string, source_format string, document_type string, created_at string, updated_at string, structure_warnings array<string>"
CHAPTER = "id string, title string, doc_name string, `order` int, paragraphs array<struct<id:string,original_text:string,translated_text:string,status:string,tag:string,index:int,source_doc:string,source_element_index:int>>"


def read_projects(spark: SparkSession, root: str) -> DataFrame:
    """Project metadata; unreadable files are left out; old projects get their type from the format."""
    from ..operators.books import project_type

    df = spark.read.schema(META).option("multiLine", "true").option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").option("pathGlobFilter", "meta.json").json(root)
    kept = df.filter("id is not null")
    return kept.withColumn("document_type", project_type(F.col("document_type"), F.col("source_format"))).withColumn("structure_warnings", F.coalesce("structure_warnings", F.array().cast("array<string>")))


def read_chapters(spark: SparkSession, root: str) -> DataFrame:
    """One row a paragraph: project_id, chapter_id and the paragraph's fields with their defaults."""
    df = spark.read.schema(CHAPTER).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "chap_*.json").json(root)
    rows = df.select(F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/(?:chapters/)?[^/]+$", 1).alias("project_id"), F.col("id").alias("chapter_id"), F.explode("paragraphs").alias("p"))
    return rows.select("project_id", "chapter_id", F.col("p.id").alias("para_id"), "p.original_text", F.coalesce("p.translated_text", F.lit("")).alias("translated_text"), F.coalesce("p.status", F.lit("pending")).alias("status"), F.coalesce("p.tag", F.lit("p")).alias("tag"), F.col("p.index").alias("para_index"), F.coalesce("p.source_doc", F.lit("")).alias("source_doc"), F.coalesce("p.source_element_index", F.lit(-1)).alias("source_element_index"))
