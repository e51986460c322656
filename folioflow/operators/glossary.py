"""Glossaries: characters and terms, the last entry of a name wins and keeps the first one's place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolved_characters(characters: DataFrame) -> DataFrame:
    key = F.lower(F.trim("name"))
    cols = ["name", "gender", "role", "first", "second", "third", "notes"]
    out = characters.groupBy("project_id", key.alias("key")).agg(F.min("pos").alias("place"), F.max_by(F.struct(*[F.trim(c).alias(c) for c in cols]), "pos").alias("c"))
    return out.select("project_id", "key", "place", *[F.col(f"c.{c}").alias(c) for c in cols])


def resolved_terms(terms: DataFrame) -> DataFrame:
    """Terms with both sides; the same rule for repeated ones."""
    kept = terms.filter((F.trim("source") != "") & (F.trim("target") != ""))
    out = kept.groupBy("project_id", F.lower(F.trim("source")).alias("key")).agg(F.min("pos").alias("place"), F.max_by(F.struct(F.trim("source").alias("source"), F.trim("target").alias("target"), F.trim("description").alias("description")), "pos").alias("t"))
    return out.select("project_id", "key", "place", "t.source", "t.target", "t.description")


def glossary_lines(characters: DataFrame, terms: DataFrame) -> DataFrame:
    """project_id, block: one line a character, then one a term, in their order."""
    c = resolved_characters(characters)
    cl = F.concat(F.lit("- "), "name", F.lit(" ("), "gender", F.lit(", "), "role", F.lit("): "), "first", F.lit("/"), "second", F.lit("/"), "third", F.when(F.col("notes") != "", F.concat(F.lit("; "), "notes")).otherwise(""))
    t = resolved_terms(terms)
    tl = F.concat(F.lit("- "), "source", F.lit(" -> "), "target", F.when(F.col("description") != "", F.concat(F.lit(" ("), "description", F.lit(")"))).otherwise(""))
    rows = c.select("project_id", F.struct(F.lit(0).alias("kind"), "place", cl.alias("line")).alias("s")).unionByName(t.select("project_id", F.struct(F.lit(1).alias("kind"), "place", tl.alias("line")).alias("s")))
    return rows.groupBy("project_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda x: x["line"]), "\n").alias("block"))


STORE = "tone string, custom_instructions string, characters array<struct<name:string,gender:string,role:string,first_person:string,second_person:string,third_person:string,notes:string>>, terms array<struct<source_term:string,target_term:string,category:string,description:string>>"


def stored(glossaries: DataFrame) -> DataFrame:
    """project_id, store: the JSON of a glossary table (project_id, tone, custom_instructions, characters, terms)."""
    return glossaries.select("project_id", F.to_json(F.struct("tone", "custom_instructions", "characters", "terms")).alias("store"))


def loaded(stores: DataFrame) -> DataFrame:
    """project_id, tone, custom_instructions, characters, terms of JSON texts (store); what lacks has its default, a broken text gives an empty glossary."""
    g = stores.withColumn("_g", F.from_json("store", STORE))

    def either(c, default: str):
        return F.coalesce(c, F.lit(default))

    people = F.transform(
        F.coalesce("_g.characters", F.array()),
        lambda c: F.struct(
            either(c["name"], "").alias("name"), either(c["gender"], "unknown").alias("gender"), either(c["role"], "").alias("role"), either(c["first_person"], "tôi").alias("first_person"),
            either(c["second_person"], "cậu").alias("second_person"), either(c["third_person"], "").alias("third_person"), either(c["notes"], "").alias("notes"),
        ),
    )
    words = F.transform(
        F.coalesce("_g.terms", F.array()),
        lambda t: F.struct(either(t["source_term"], "").alias("source_term"), either(t["target_term"], "").alias("target_term"), either(t["category"], "general").alias("category"), either(t["description"], "").alias("description")),
    )
    return g.select("project_id", either(F.col("_g.tone"), "novel").alias("tone"), either(F.col("_g.custom_instructions"), "").alias("custom_instructions"), people.alias("characters"), words.alias("terms"))


def lookup(names: DataFrame, characters: DataFrame) -> DataFrame:
    """names (project_id, name) with the character of the same name without case and outer blanks, or none."""
    own = resolved_characters(characters).select("project_id", "key", F.col("name").alias("character"), "first", "second", "third")
    return names.withColumn("key", F.lower(F.trim("name"))).join(own, ["project_id", "key"], "left").drop("key")
