"""Freely typed values to the entries of a reference list.

Distinct tokens that the reference does not know are joined to its vocabulary
by edit distance: both sides are spelled with letters left out, so the join is
an equality, and the slips of the pairs that meet are counted exactly. The
repaired tokens look names up in an inverted index, by the rarest word of each
name, whatever their order and what stands between; soft TF-IDF of the names
and the parts of a value then ranks complete entries, and country, region and
population decide between entries of one name. All but the cutting of values
into tokens is declared with joins, aggregations and array functions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.functions.places import AROUND, ARRANGEMENT, Gazetteer, gazetteer, shortened, slips, slips_allowed, tokens
from lathe.operators.joins import skewed
from lathe.operators.splitting import located, split_values
from lathe.session import bounded_broadcast, cut, growing, spread, table

#: Least soft TF-IDF of a value's part and an entry's name.
LEAST_SCORE = 0.8
#: Letters of an unknown token from which it may be a slip.
LEAST_LETTERS = 5
_SEGMENT = re.compile(r"[,;()\[\]\r\n|•·]|\s[-–—]\s|\s[-–—]|[-–—]\s|[:]\s")


TOKENS = "array<struct<token:string,seg:int,weight:double,counts:boolean>>"


def tokenized(values: DataFrame, names) -> DataFrame:
    """(val, toks): folded tokens of each value, the part each stands in, its weight, and whether it counts against a name.

    Words of a working arrangement or around names, and numbers, do not count.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = names.value
        for b in batches:
            out = []
            for v in b["val"]:
                toks = [(t, k) for k, part in enumerate(_SEGMENT.split(v)) for t in tokens(part)]
                out.append([{"token": t, "seg": k, "weight": g.idf.get(t, g.rare), "counts": not (t in ARRANGEMENT or t in AROUND or t.isdigit())} for t, k in toks])
            yield pd.DataFrame({"val": b["val"], "toks": out})

    return values.mapInPandas(run, f"val string, toks {TOKENS}")


ENTRIES = "array<struct<ref:string,kind:string,country:string,region:string,population:long>>"


def name_index(spark: SparkSession, g: Gazetteer) -> DataFrame:
    """(anchor, name, words, entries): each listed name under its rarest word; a bounded table, as the lists are."""
    rows = []
    for k, (t, entries) in enumerate(sorted(g.names.items())):
        words = [(w, t.count(w), g.idf[w]) for w in sorted(set(t))]
        said = sorted((e.ref, e.kind, e.country, e.region, e.population) for e in entries)
        rows.append((max(words, key=lambda x: (x[2], len(x[0]), x[0]))[0], k, words, said))
    return spark.createDataFrame(rows, f"anchor string, name int, words array<struct<word:string,times:int,weight:double>>, entries {ENTRIES}")


def vocabulary_variants(spark: SparkSession, names: Gazetteer) -> DataFrame:
    """(word, variant): listed words that may hold slips, with up to so many letters left out."""
    words = sorted(w for w in names.vocabulary if slips_allowed(w))
    df = spark.createDataFrame([(w,) for w in words], "word string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(w, v) for w in b["word"] for v in shortened(w, slips_allowed(w))]
            yield pd.DataFrame(rows, columns=["word", "variant"])

    return df.mapInPandas(run, "word string, variant string")


def repaired_tokens(toks: DataFrame, variants: DataFrame) -> DataFrame:
    """(token, near): for each distinct token the closest listed words and their slips."""

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(t, v) for t in b["token"] for v in shortened(t, min(2, max(len(t) - 1, 0)))]
            yield pd.DataFrame(rows, columns=["token", "variant"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            d = [slips(t, w, slips_allowed(w)) for t, w in zip(b["token"], b["word"], strict=True)]
            out = b.assign(slips=d)
            yield out[[x <= slips_allowed(w) for x, w in zip(d, b["word"], strict=True)]]

    met = toks.mapInPandas(spell, "token string, variant string").join(variants, "variant").select("token", "word").distinct()
    near = met.mapInPandas(count, "token string, word string, slips int")
    least = near.groupBy("token").agg(F.min("slips").alias("least"), F.collect_list(F.struct("word", "slips")).alias("all"))
    return least.select("token", F.array_sort(F.filter("all", lambda x: x["slips"] == F.col("least"))).alias("near"))


def candidates(parts: DataFrame, index: DataFrame) -> DataFrame:
    """(val, toks, found): the listed names that the tokens of one part of a value say in full.

    ``parts`` has (val, toks, repairs). A token stands for itself or, where the
    lists do not know it, for all its equally near words. A name's anchor is one
    of its words, so an equality join by it misses no name; the other words are
    then looked for in the part, a word that a name has twice at two places.
    Each of ``found`` has the places that say the name, its slips, weights and entries.
    """
    near = F.transform("toks", lambda t, i: F.struct(t["seg"].alias("seg"), i.alias("at"), F.coalesce(F.col("repairs")[t["token"]], F.array(F.struct(t["token"].alias("word"), F.lit(0).alias("slips")))).alias("near")))
    held = parts.select("val", "toks", near.alias("near"))
    # Only words travel to the index, so a value of very many tokens is never repeated for each of them.
    said = F.array_distinct(F.flatten(F.transform("near", lambda t: F.transform(t["near"], lambda x: F.struct(t["seg"].alias("seg"), x["word"].alias("anchor"))))))
    met = held.select("val", F.explode(said).alias("x")).select("val", "x.*").join(index, "anchor")
    names = met.groupBy("val").agg(F.collect_set(F.struct("seg", "name", "words", "entries")).alias("names"))
    zero = F.lit(0.0)

    def at_word(c, w):
        here = F.filter("near", lambda t: (t["seg"] == c["seg"]) & F.exists(t["near"], lambda x: x["word"] == w["word"]))
        slips = F.transform(here, lambda t: F.struct(F.array_min(F.transform(F.filter(t["near"], lambda x: x["word"] == w["word"]), lambda x: x["slips"])).alias("slips"), t["at"].alias("at")))
        return F.struct(F.slice(F.array_sort(slips), F.lit(1), w["times"]).alias("said"), (F.size(slips) >= w["times"]).alias("whole"), w["weight"].alias("weight"), F.length(w["word"]).alias("n"), w["times"].alias("times"))

    by = F.transform("names", lambda c: F.struct(c.alias("c"), F.transform(c["words"], lambda w: at_word(c, w)).alias("by")))

    def told(x):
        dot = F.aggregate(x["by"], zero, lambda s, w: s + F.aggregate(w["said"], zero, lambda t, y: t + w["weight"] * w["weight"] * (1 - 0.5 * y["slips"] / w["n"])))
        full = F.aggregate(x["by"], zero, lambda s, w: s + w["weight"] * w["weight"] * w["times"])
        slips = F.aggregate(x["by"], F.lit(0), lambda s, w: s + F.aggregate(w["said"], F.lit(0), lambda t, y: t + y["slips"]))
        at = F.array_sort(F.flatten(F.transform(x["by"], lambda w: w["said"]["at"])))
        # Longer names first, then fewer slips, closer together, further left.
        return F.struct(
            (-F.size(at)).alias("n"), slips.alias("slips"), (F.array_max(at) - F.array_min(at)).alias("span"), F.array_min(at).alias("first"), x["c"]["name"].alias("name"), x["c"]["seg"].alias("seg"),
            at.alias("at"), dot.alias("dot"), full.alias("full"), x["c"]["entries"].alias("entries"),
        )

    both = held.join(growing(names), "val", "left").select("val", "toks", F.filter(by, lambda x: F.forall(x["by"], lambda w: w["whole"])).alias("by"))
    return both.select("val", "toks", F.array_sort(F.transform("by", told)).alias("found"))


def ranked(found: DataFrame) -> DataFrame:
    """(val, ref, score): the entry that a value means.

    Names that share a place with a better one drop out, but for those that say
    the very same places. Countries that are named, alone or beside, allow only
    places of theirs. The score is the soft TF-IDF of a name and what its part
    says beside countries, regions and words around names; from ``LEAST_SCORE``
    on the best one wins, then fewer slips, a named region, and the first.
    """
    kept = F.aggregate(
        "found", F.expr("cast(array() AS array<struct<n:int,slips:int,span:int,first:int,name:int,seg:int,at:array<int>,dot:double,full:double,entries:" + ENTRIES + ">>)"),
        lambda out, c: F.when(F.exists(out, lambda k: F.arrays_overlap(k["at"], c["at"]) & (k["at"] != c["at"])), out).otherwise(F.concat(out, F.array(c))),
    )
    kind = lambda c, k: F.exists(c["entries"], lambda e: e["kind"] == k)
    df = found.select("val", "toks", F.coalesce(kept, F.array()).alias("kept"))
    countries = F.flatten(F.transform(F.filter("kept", lambda c: kind(c, "country")), lambda c: F.filter(c["entries"], lambda e: e["kind"] == "country")["country"]))
    regions = F.flatten(F.transform("kept", lambda c: F.transform(F.filter(c["entries"], lambda e: e["kind"] == "region"), lambda e: F.struct(e["region"], e["country"]))))
    aside = F.flatten(F.transform(F.filter("kept", lambda c: ~kind(c, "place")), lambda c: c["at"]))
    first = F.get(F.array_sort(F.transform(F.filter("kept", lambda c: kind(c, "country")), lambda c: F.struct(c["first"], F.array_min(F.filter(c["entries"], lambda e: e["kind"] == "country")["country"]).alias("code")))), F.lit(0))["code"]
    df = df.withColumns({"countries": countries, "regions": regions, "aside": aside, "first": first})

    def judged(c):
        here = F.filter(c["entries"], lambda e: (e["kind"] == "place") & ((F.size("countries") == 0) | F.array_contains("countries", e["country"])))
        best = F.array_max(F.transform(here, lambda e: F.struct(F.array_contains("regions", F.struct(e["region"], e["country"])).alias("region"), e["population"].alias("population"), e["ref"].alias("ref"))))
        other = F.filter(F.transform("toks", lambda t, i: F.struct(t["seg"].alias("seg"), t["counts"].alias("counts"), t["weight"].alias("weight"), i.alias("at"))), lambda t: (t["seg"] == c["seg"]) & t["counts"] & ~F.array_contains(c["at"], t["at"]) & ~F.array_contains("aside", t["at"]))
        own = c["full"] + F.aggregate(other, F.lit(0.0), lambda s, t: s + t["weight"] * t["weight"])
        score = F.when(own > 0, c["dot"] / F.sqrt(own * c["full"])).otherwise(0.0)
        return F.struct(F.round(score, 6).alias("rank"), (-c["slips"]).alias("few"), best["region"].alias("region"), (-c["first"]).alias("left"), best["population"].alias("population"), best["ref"].alias("ref"), score.alias("score"))

    top = F.array_max(F.filter(F.transform(F.filter("kept", lambda c: kind(c, "place")), judged), lambda j: j["ref"].isNotNull() & (j["score"] >= LEAST_SCORE)))
    df = df.select("val", "first", top.alias("top"))
    ref = F.when(F.col("top").isNotNull(), F.col("top.ref")).when(F.col("first").isNotNull(), F.concat(F.lit("country:"), "first")).otherwise("none")
    score = F.when(F.col("top").isNotNull(), F.col("top.score")).when(F.col("first").isNotNull(), 1.0).otherwise(0.0)
    return df.select("val", ref.alias("ref"), score.alias("score"))


def mapped(values: DataFrame, places: DataFrame, countries: DataFrame) -> DataFrame:
    """(val, ref, score) of each distinct value.

    Values without a listed name are ``none``; null values are left out. Equal
    candidates go by region, then population, then id. The reference lists are
    bounded tables and held by every task; tokens and values stay distributed.
    """
    spark = values.sparkSession
    g = gazetteer(places, countries)
    names = spark.sparkContext.broadcast(g)
    known = sorted(g.vocabulary | ARRANGEMENT | AROUND)
    parts = cut(tokenized(spread(values.select("val").where("val IS NOT NULL").distinct(), "val"), names))
    each = parts.select("val", F.explode(F.array_distinct("toks.token")).alias("token")).where((F.length("token") >= LEAST_LETTERS) & ~F.col("token").rlike(r"^\d+$"))
    listed = bounded_broadcast(spark.createDataFrame([(w,) for w in known], "token string"))
    odd = cut(each.join(listed, "token", "left_anti"))
    variants = bounded_broadcast(vocabulary_variants(spark, g))
    near = repaired_tokens(spread(odd.select("token").distinct(), "token"), variants)
    repaired = odd.join(growing(near), "token").groupBy("val").agg(F.map_from_entries(F.collect_list(F.struct("token", "near"))).alias("repairs"))
    whole = parts.join(growing(repaired), "val", "left")
    return ranked(candidates(whole, bounded_broadcast(name_index(spark, g))))


def located_values(greenhouse: DataFrame, records: DataFrame, places: DataFrame, countries: DataFrame) -> DataFrame:
    """(tbl, row_id, pos, val): elements of job_records.locations and values of greenhouse_jobs.location.name."""
    blank = r"^[\s\u00a0\u200b\ufeff]*$"
    listed = records.select(F.lit("job_records").alias("tbl"), "row_id", F.posexplode("locations").alias("i", "val"))
    listed = listed.where("val IS NOT NULL").where(~F.col("val").rlike(blank)).select("tbl", "row_id", (F.col("i") + 1).cast("long").alias("pos"), "val")
    split = split_values(located(greenhouse, records), "id", "field", places, countries)
    typed = split.where("id.tbl = 'greenhouse_jobs'").select("id.tbl", "id.row_id", "pos", "val")
    return listed.unionByName(typed)


def matches(greenhouse: DataFrame, records: DataFrame, places: DataFrame, countries: DataFrame) -> DataFrame:
    """(tbl, row_id, pos, val, ref, score) of every value."""
    values = cut(located_values(greenhouse, records, places, countries))
    counts = cut(values.groupBy("val").agg(F.count(F.lit(1)).alias("n")))
    return skewed(values, mapped(counts, places, countries), ["val"], "n", counts=counts)


def _tables(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, t) for t in ("greenhouse_jobs", "job_records", "places", "countries")]


def found(spark: SparkSession, d: str) -> DataFrame:
    """p1_found."""
    return matches(*_tables(spark, d)).select("tbl", "row_id", "pos", "ref")


def unmatched(spark: SparkSession, d: str) -> DataFrame:
    """p1_unmatched: the values that mean no entry, with their number of rows."""
    return matches(*_tables(spark, d)).where("ref = 'none'").groupBy("val").agg(F.count(F.lit(1)).alias("n_rows"))
