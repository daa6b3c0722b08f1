"""Facts about records from several statements or sources: the standing one, agreement, ownership, entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathe.functions.timestamps import MONTHS


def standing(df: DataFrame, keys: list[str], at: list[Column]) -> DataFrame:
    """Adds ``active``: only the last statement of a key stands, earlier ones are superseded."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in at])
    return df.withColumn("active", F.row_number().over(w) == 1)


def composed(df: DataFrame, keys: list[str], value: str, precedence: Column, tie: str) -> DataFrame:
    """(keys, value, agreeing, others): the value of highest precedence, how many agree, and how many different ones there are."""
    best = df.groupBy(*keys).agg(F.min_by(value, F.struct(precedence.alias("p"), F.col(tie))).alias("value"), F.countDistinct(value).alias("kinds"))
    counts = df.groupBy(*keys, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("agreeing"))
    return best.join(counts, [*keys, "value"]).select(*keys, "value", "agreeing", (F.col("kinds") - 1).alias("others"))


def owned_fields(df: DataFrame, keys: list[str], value: str, edited: Column, at: str, tie: str) -> DataFrame:
    """(keys, value, disputed): an edit by hand stands, else the latest value; disputed where sources differ and none was edited."""
    order = F.struct(edited.cast("int"), F.col(at), F.col(tie))
    return df.groupBy(*keys).agg(F.max_by(value, order).alias("value"), ((F.countDistinct(value) > 1) & ~F.bool_or(edited)).alias("disputed"))


def majority(df: DataFrame, keys: list[str], answer: str, unclear: Column) -> DataFrame:
    """(keys, verdict): the answer of more than half the votes; any unclear or missing vote, or none so frequent, makes it unclear."""
    votes = df.groupBy(*keys, answer).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.coalesce(unclear, F.lit(True)) | F.col(answer).isNull()).alias("veto"))
    all_ = votes.groupBy(*keys).agg(F.sum("n").alias("total"), F.bool_or("veto").alias("veto"), F.max_by(answer, F.struct("n", answer)).alias("top"), F.max("n").alias("most"))
    return all_.select(*keys, F.when(F.col("veto") | (F.col("most") * 2 <= F.col("total")), F.lit("unclear")).otherwise(F.col("top")).alias("verdict"))


def stability(df: DataFrame, keys: list[str], answer: str) -> DataFrame:
    """(items, stable_share): share of keys whose answers are all equal, a missing one an answer of its own."""
    each = df.groupBy(*keys).agg((F.countDistinct(F.coalesce(F.col(answer), F.lit("\x00"))) == 1).cast("int").alias("same"))
    return each.agg(F.count(F.lit(1)).alias("items"), F.round(F.avg("same"), 4).alias("stable_share"))


def precision(df: DataFrame, keys: list[str], surfaced: Column, right: Column, fair: Column) -> DataFrame:
    """(keys, surfaced, strict, relaxed): shares among the surfaced, null where nothing was."""
    n = F.count_if(surfaced)
    share = lambda c: F.round(F.try_divide(F.count_if(surfaced & c), n), 4)
    return df.groupBy(*keys).agg(n.alias("surfaced"), share(right).alias("strict"), share(right | fair).alias("relaxed"))


def entities(df: DataFrame, kind: str, key: str, fields: list[str]) -> DataFrame:
    """(kind, key, body, digest): each row as canonical JSON, fields in order of name, and its digest."""
    body = F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"})
    return df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), body.alias("body")).withColumn("digest", F.sha2("body", 256))


def recomposed(entities_: DataFrame, kind: str, key: str, fields: dict[str, str]) -> DataFrame:
    """Entities of a kind as typed rows again: (key, fields)."""
    body = F.from_json("body", ", ".join(f"`{c}` {t}" for c, t in fields.items()))
    return entities_.where(F.col("kind") == kind).select(F.col("key").alias(key), body.alias("b")).select(key, *[F.col(f"b.{c}").alias(c) for c in fields])


def without_source(support: DataFrame, key: str, source: str, gone: Column) -> DataFrame:
    """(key, left_sources): what other sources still support after one is removed; what only that one did has no row."""
    return support.where(~gone).groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(source)), ",").alias("left_sources"))


def changed_entities(stored: DataFrame, now: DataFrame) -> DataFrame:
    """(kind, key, change): entities put, by new digest, and deleted."""
    s, n = stored.select("kind", "key", F.col("digest").alias("was")), now.select("kind", "key", F.col("digest").alias("is"))
    both = s.join(n, ["kind", "key"], "full_outer")
    change = F.when(F.col("is").isNull(), "deleted").when(~F.col("is").eqNullSafe(F.col("was")), "put")
    return both.select("kind", "key", change.alias("change")).where("change IS NOT NULL")


def sightings(leads: DataFrame, key: str, at: str, fields: list[str], where: str) -> DataFrame:
    """(key, fields, seen, places): leads of one key merged; each field is the first that is known, places are counted once."""
    first = [F.min_by(F.col(f), F.when(F.col(f).isNotNull(), F.struct(F.col(at), F.col(f)))).alias(f) for f in fields]
    return leads.where(F.col(key).isNotNull()).groupBy(key).agg(*first, F.count(F.lit(1)).alias("seen"), F.countDistinct(where).alias("places"))


def plausible_readings(candidates: DataFrame, name: str, ref: str, weight: str, least: float = 0.1) -> DataFrame:
    """(name, refs, ambiguous): readings of a name that have at least a share of the heaviest one's weight."""
    top = candidates.groupBy(name).agg(F.max(weight).alias("__top"))
    kept = candidates.join(top, name).where(F.col(weight) >= F.col("__top") * least)
    return kept.groupBy(name).agg(F.countDistinct(ref).alias("refs"), F.max_by(ref, F.struct(weight, ref)).alias("first")).withColumn("ambiguous", F.col("refs") > 1)


def date_ranges(c: Column) -> Column:
    """array<string>: spans like "Mar 2021 – Present" or "2019 - 2021" in a line, in order."""
    names = "|".join(sorted({m for line in MONTHS.values() for m in line.split()}, key=len, reverse=True))
    month = rf"(?:(?:{names})\.?\s+(?:de\s+)?|\d{{1,2}}/)?"
    return F.regexp_extract_all(c, F.lit(rf"(?iU)(\b{month}(?:19|20)\d\d\s*(?:-|–|—|to|bis|a|à)\s*(?:{month}(?:19|20)\d\d\b|present|current|now|today|heute))"), 1)
