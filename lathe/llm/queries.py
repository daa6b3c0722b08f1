"""Queries of the training-data operators by name: callables of (spark, folder)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lathe.llm import language, matching, neardup, packing, sql, tokenizer
from lathe.session import cut, table


def p7_ids(spark, d):
    """Ids of every document by byte_bpe_50k."""
    return tokenizer.encode_documents(table(spark, d, "documents"))


def p8_containers(spark, d):
    """Documents in containers of 2,048 ids."""
    return packing.pack_documents(table(spark, d, "documents"))


def p1_exact(spark, d):
    """Distinct values of locations that spell just one listed name, as the operator maps them."""
    p, c = table(spark, d, "places"), table(spark, d, "countries")
    k = lambda x: F.lower(F.trim(x)).alias("k")
    place, country = F.concat(F.lit("place:"), F.col("geo_id").cast("string")).alias("ref"), F.concat(F.lit("country:"), "code").alias("ref")
    names = p.select(k("name"), place).unionByName(p.select(F.explode("other_names").alias("n"), place).select(k("n"), "ref")).unionByName(c.select(k("c1"), country))
    names = names.unionByName(c.select(F.explode("other_names").alias("n"), country).select(k("n"), "ref")).unionByName(c.select(k("code"), country))
    names = names.unionByName(p.where("region IS NOT NULL").select(k("region"), F.concat(F.lit("region:"), "country_code", "region").alias("ref")))
    one = names.groupBy("k").agg(F.min("ref").alias("ref"), F.countDistinct("ref").alias("n")).where("n = 1 AND NOT startswith(ref, 'region')").select("k")
    values = table(spark, d, "job_records").select(F.explode("locations").alias("val")).distinct()
    spelled = values.withColumn("k", F.lower(F.trim("val"))).join(one, "k", "left_semi").select("val")
    return matching.mapped(spelled, p, c).select("val", "ref")


def p8_invariants(spark, d):
    """Documents, and those that the packing lost, put into too full containers, or split though they fit."""
    documents = table(spark, d, "documents")
    packed = cut(packing.pack_documents(documents))
    sizes = documents.select("doc_id", tokenizer.token_count(F.col("text")).alias("size"))
    placed = packed.groupBy("doc_id").agg(F.sum("length").alias("used"), F.count(F.lit(1)).alias("parts"))
    held = packed.groupBy("container_id").agg(F.sum("length").alias("fill")).where("container_id > 0 OR fill > 0")
    both = sizes.join(placed, "doc_id", "left")
    kept = both.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("used").isNull() | (F.col("used") != F.col("size"))).alias("unplaced"), F.count_if((F.col("parts") > 1) & (F.col("size") <= 2048)).alias("split_short"))
    full = held.agg(F.count_if(F.col("fill") > 2048).alias("overfull"))
    return kept.withColumn("all", F.lit(1)).join(full.withColumn("all", F.lit(1)), "all").select("documents", "unplaced", "overfull", "split_short")  # one row each


QUERIES = {
    "p1_found": matching.found,
    "p1_unmatched": matching.unmatched,
    "p1_exact": p1_exact,
    "p2_found": neardup.found,
    "p2_groups": neardup.opening_classes,
    "p7_ids": p7_ids,
    "p8_containers": p8_containers,
    "p8_invariants": p8_invariants,
    "p9_found": language.found,
    "p9_languages": language.all_languages,
}
SQL = sql.SQL
