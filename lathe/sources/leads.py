"""Recorded discovery payloads to leads (name, url, board, place, provider)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.functions.html import html_to_text
from lathe.functions.text import clean_line
from lathe.functions.urls import board_reference, canonical_url

CDX = "url string, status string, mime string, timestamp string, digest string"
THREAD = "id bigint, title string, children array<struct<id:bigint,author:string,text:string,created_at_i:bigint>>"
COMPANY = "name string, website string, all_locations string, isHiring boolean, status string"


def _lead(name: Column, url: Column, place: Column, provider: str) -> list[Column]:
    u = canonical_url(url)
    return [clean_line(name).alias("name"), u.alias("url"), board_reference(url).alias("board"), clean_line(place).alias("place"), F.lit(provider).alias("provider")]


def crawl_index(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a crawl's index in JSON lines that were read well, the last capture of each URL."""
    null = F.lit(None).cast("string")
    df = spark.read.schema(CDX).json(path).where("status = '200' AND url IS NOT NULL")
    last = df.groupBy("url").agg(F.max("timestamp").alias("timestamp"))
    return last.select(*_lead(null, F.col("url"), null, "crawl index"), "timestamp")


def hiring_thread(threads: DataFrame) -> DataFrame:
    """Leads of hiring threads (body string): a comment's first line names company and place between bars."""
    c = threads.select(F.explode(F.from_json("body", THREAD)["children"]).alias("c")).where("c.text IS NOT NULL")
    t = c.select("c.id", html_to_text(F.col("c.text")).alias("text"), F.regexp_extract("c.text", r"""href="(https?:[^"]+)\"""", 1).alias("href"))
    t = t.withColumn("head", F.split(F.element_at(F.split("text", "\n"), 1), r"\s*\|\s*"))
    url = F.replace(F.replace(F.nullif("href", F.lit("")), F.lit("&#x2F;"), F.lit("/")), F.lit("&amp;"), F.lit("&"))
    rows = t.where(F.size("head") > 1).withColumn("link", url)
    return rows.select("id", *_lead(F.get("head", F.lit(0)), F.coalesce("link", F.lit("")), F.get("head", F.lit(2)), "hiring thread"))


def company_directory(spark: SparkSession, path: str) -> DataFrame:
    """Companies of a directory in JSON that hire and still exist."""
    df = spark.read.schema(COMPANY).json(path, multiLine=True).where("isHiring AND coalesce(status, '') <> 'Inactive' AND name IS NOT NULL")
    return df.select(*_lead(F.col("name"), F.coalesce("website", F.lit("")), F.element_at(F.split(F.coalesce("all_locations", F.lit("")), ";"), 1), "directory"))
