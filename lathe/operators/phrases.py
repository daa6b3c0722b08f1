"""Phrases of a vocabulary in texts: one pass over the words, one equality join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.functions.text import search_key
from lathe.session import bounded_broadcast


def word_runs(words: Column, longest: int) -> Column:
    """array<struct<pos,n,run>>: all runs of up to ``longest`` words, joined by blanks, with their places from 0."""
    each = lambda n: F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.struct(i.alias("pos"), F.lit(n).alias("n"), F.array_join(F.slice(words, i + 1, n), " ").alias("run")))
    none = F.array().cast("array<struct<pos:int,n:int,run:string>>")
    return F.concat(*[F.when(F.size(words) >= n, each(n)).otherwise(none) for n in range(1, longest + 1)])


def phrases_in(texts: DataFrame, key: str, text: str, vocabulary: DataFrame, phrase: str) -> DataFrame:
    """(key, pos, n, <vocabulary's columns>): where the words of a text say a phrase, letter case and signs aside.

    The vocabulary's longest phrase, in words, bounds the runs that are looked
    up; texts are read whole. Overlapping phrases are all found. Null texts and
    blank phrases give none; a phrase listed twice is found twice.
    """
    v = vocabulary.withColumn("__run", search_key(phrase)).where("__run <> ''")
    longest = v.agg(F.max(F.size(F.split("__run", " ")))).first()[0]  # one number
    words = F.filter(F.split(search_key(text), " "), lambda w: w != "")
    runs = texts.where(F.col(text).isNotNull()).select(key, words.alias("__w")).select(key, F.explode(word_runs(F.col("__w"), longest or 1)).alias("__x")).select(key, "__x.pos", "__x.n", F.col("__x.run").alias("__run"))
    return runs.join(bounded_broadcast(v), "__run").drop("__run")


def clauses(c: Column | str) -> Column:
    """array<string>: clauses of a text: cut at commas, semicolons, colons, dashes between blanks, ends of sentences and lines, and before but, although and however."""
    c = F.col(c) if isinstance(c, str) else c
    marked = F.regexp_replace(c, r"(?i)\s+(but|although|however)\s", "\n$1 ")
    marked = F.regexp_replace(marked, r"[,;:](\s+)|\s[-–—]\s|[.!?](\s+)", "\n")
    return F.filter(F.transform(F.split(marked, r"[\r\n]+"), lambda x: F.trim(F.regexp_replace(x, r"[.!?]+\s*$", ""))), lambda x: x != "")
