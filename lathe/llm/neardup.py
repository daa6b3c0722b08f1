"""Near-duplicate records: MinHash LSH forest, exact verification, components.

Each distinct text has one signature per tree of the forest. A tree is a prefix
trie: at the final depth, where all trees together reach the target recall for
a pair at the threshold, a text stays in the trie only where it shares its
prefix with another one, and it carries the longer prefixes along. Matching
starts at the longest prefixes, where sharing one nearly proves a copy and a
member is compared with its bucket's first only. Prefixes are then shortened
step by step, and a text leaves the trie as soon as it shares no prefix of the
final depth with a text of another group, since shorter ones could add nothing.
At the final depth the texts of different groups are compared, on their exact
shingle sets. Buckets that hold very many groups, as boilerplate makes them, are
not crossed but joined by their rarest shingles, which finds the same pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lathe.operators.graph import connected_components
from lathe.operators.joins import skewed
from lathe.session import bounded_broadcast, cut, growing, table

TREES = 50
#: Depths above the final one that prefixes start at, and by which they get shorter.
STEPS, STRIDE = 4, 2
TARGET_RECALL = 0.998
#: Groups of one bucket that are compared with each other; members of fuller buckets are joined by rare shingles.
MOST_STRANGERS = 128
_CODE_BITS = 64 // STEPS


def expected_recall(similarity: float, depth: int, trees: int = TREES) -> float:
    """Chance that a pair shares a prefix of this depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def final_depth(threshold: float, trees: int = TREES, target: float = TARGET_RECALL) -> int:
    """The longest prefix that reaches the target recall for pairs at the threshold."""
    depth = 0
    while expected_recall(threshold, depth + 1, trees) >= target and depth < 64:
        depth += 1
    if not depth:
        raise ValueError("too few trees for this threshold and recall")
    return depth


def shingle_hashes(words: list[str], width: int, known: dict[str, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``width`` words."""
    import xxhash

    n = len(words) - width + 1
    if n < 1:
        return np.empty(0, np.int64)
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w.encode())
    h = np.fromiter((known[w] for w in words), np.uint64, len(words))
    out = np.zeros(n, np.uint64)
    for k in range(width):  # a polynomial of the words' hashes, mixed so that its bits are even
        out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ (h[k : k + n] + np.uint64(k + 1))
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((out ^ (out >> np.uint64(32))).view(np.int64))


def shingled(texts: DataFrame, width: int) -> DataFrame:
    """(id, said, shingles) of (key, text); ``said`` is equal for equal word sequences."""
    words = F.trim(F.regexp_replace("text", r"[^\p{L}\p{N}]+", " "))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for b in batches:
            if len(known) > 500_000:
                known.clear()
            said = [hashlib.md5(t.encode(), usedforsecurity=False).digest() for t in b["words"]]
            yield pd.DataFrame({"id": b["key"], "said": said, "shingles": [shingle_hashes(t.split(), width, known) for t in b["words"]]})

    return texts.select("key", words.alias("words")).mapInPandas(run, "id long, said binary, shingles array<long>")


def forest_keys(sets: DataFrame, final: int, trees: int = TREES) -> DataFrame:
    """(id, n, keys, paths, bits): the number of shingles, of each tree the prefix of the final depth as a hash, and codes of the steps beyond it.

    A path has ``STEPS`` codes, the first in its highest bits. The sketch has one
    bit of each minimum, 64 to a long.
    """
    deepest = final + STEPS
    width = trees * deepest
    rng = np.random.default_rng(20240131)
    a = rng.integers(1, 2**63, width, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 2**63, width, dtype=np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = np.arange(trees, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            out, paths, sketch = [], [], []
            for s in batch["shingles"]:
                x, low = np.asarray(s, np.int64).view(np.uint64), None
                for i in range(0, len(x), 256):  # blocks that stay in the processor's cache
                    m = x[i : i + 256, None] * a
                    m += b
                    m = m.min(axis=0)
                    low = m if low is None else np.minimum(low, m)
                sig, keys = low.reshape(trees, deepest), tree.copy()
                for d in range(final):
                    keys = (keys ^ sig[:, d]) * np.uint64(0xFF51AFD7ED558CCD)
                    keys ^= keys >> np.uint64(33)
                path = np.zeros(trees, np.uint64)
                for d in range(final, deepest):
                    path = (path << np.uint64(_CODE_BITS)) | ((sig[:, d] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - _CODE_BITS))
                out.append(keys.view(np.int64))
                paths.append(path.view(np.int64))
                bits = (low * np.uint64(0xC4CEB9FE1A85EC53)) >> np.uint64(63)
                sketch.append(np.packbits(bits[: width // 64 * 64].astype(np.uint8)).view(np.int64))
            yield pd.DataFrame({"id": batch["id"], "n": [len(s) for s in batch["shingles"]], "keys": out, "paths": paths, "bits": sketch}).astype({"n": "int32"})

    return sets.select("id", "shingles").mapInPandas(run, "id long, n int, keys array<long>, paths array<long>, bits array<long>")


def least_equal_bits(threshold: float, bits: int) -> int:
    """Equal sketch bits that a pair at the threshold misses with a chance under 1e-5 (4.5 deviations)."""
    return math.floor(bits * (1 + threshold) / 2 - 4.5 * math.sqrt(bits * (1 - threshold**2) / 4))


def verified(pairs: DataFrame, forest: DataFrame, sets: DataFrame, threshold: float, bits: int) -> DataFrame:
    """Of (a, b) the pairs whose exact Jaccard similarity reaches the threshold.

    Sizes and sketches, a few bytes a text, rule most pairs out before any set is fetched.
    """
    small = growing(forest.select("id", "n", "bits"))
    near = pairs.join(small.withColumnsRenamed({"id": "a", "n": "na", "bits": "ba"}), "a").join(small.withColumnsRenamed({"id": "b", "n": "nb", "bits": "bb"}), "b")
    equal = F.lit(bits) - sum((F.bit_count(F.get("ba", F.lit(i)).bitwiseXOR(F.get("bb", F.lit(i)))) for i in range(bits // 64)), F.lit(0))
    near = near.where((F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(threshold - 1e-9)) & (equal >= least_equal_bits(threshold, bits))).select("a", "b")
    near = cut(near)
    # Sets are long and pairs are few: only the sets of pairs are moved.
    ids = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    s = growing(sets.select("id", "shingles").join(bounded_broadcast(ids), "id", "left_semi"))
    both = near.join(s.withColumnsRenamed({"id": "a", "shingles": "sa"}), "a").join(s.withColumnsRenamed({"id": "b", "shingles": "sb"}), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared >= (F.size("sa") + F.size("sb") - shared) * F.lit(threshold) - 1e-9).select("a", "b")


def groups(df: DataFrame, key: str, text: str, width: int = 5, threshold: float = 0.8, trees: int = TREES, target: float = TARGET_RECALL, most: int = MOST_STRANGERS) -> DataFrame:
    """(key, group): every row with a usable text and its group's least key.

    Two rows are linked when the Jaccard similarity of their sets of ``width``
    consecutive words, in lower case, is at least ``threshold``; a group is what
    links connect. Rows with equal words are one group whatever their length;
    other rows with fewer than ``width`` words, which have no shingles, stand
    alone. Rows with a null key or text are left out. Keys must be unique.
    """
    final = final_depth(threshold, trees, target)
    texts = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.lower(F.col(text)).alias("text"))
    same = cut(texts.select("key", F.unhex(F.md5("text")).alias("same")))
    classes = cut(same.groupBy("same").agg(F.min("key").alias("id"), F.count(F.lit(1)).alias("n")))
    member = cut(skewed(same, classes, ["same"], "n").select("key", "id"))
    # Only one row of each class of copies goes on, and its text travels rather than its shingles.
    chosen = texts.join(growing(classes.select(F.col("id").alias("key"))), "key", "left_semi")
    all_sets = cut(shingled(chosen, width))
    said = all_sets.select("id", "said")
    twins = said.groupBy("said").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    edges = cut(skewed(said, twins, ["said"], "n").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")))
    sets = all_sets.select("id", "shingles").where(F.size("shingles") > 0)
    forest = cut(forest_keys(sets, final, trees))
    bits = trees * (final + STEPS) // 64 * 64
    trie = cut(shared_prefixes(forest))
    comp = None
    for depth in range(final + STEPS, final - 1, -STRIDE):
        trie = trie if comp is None else cut(active(trie, comp))
        if depth > final:
            candidates = first_of_bucket(trie, depth - final)
        else:
            candidates = strangers(trie, sets, threshold, most)
        found = cut(verified(candidates, forest, sets, threshold, bits))
        edges = edges.unionByName(found)
        comp = connected_components(edges, "a", "b")
        if trie.isEmpty():
            break
    grouped = member.join(comp.withColumnRenamed("node", "id"), "id", "left")
    return grouped.select(F.col("key").alias(key), F.coalesce("component", "id").alias("group"))


def shared_prefixes(forest: DataFrame) -> DataFrame:
    """(key, path, id, comp): the trie's entries of the final depth that two records and more share."""
    each = forest.select("id", F.explode(F.arrays_zip("keys", "paths")).alias("x")).select("id", F.col("x.keys").alias("key"), F.col("x.paths").alias("path"))
    # Counted with partial sums first: a prefix that a third of all records share is one row of the counts.
    shared = each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return skewed(each, shared, ["key"], "n").select("key", "path", "id", F.col("id").alias("comp"))


def active(trie: DataFrame, comp: DataFrame) -> DataFrame:
    """The entries, with their present groups, of prefixes of the final depth that different groups still share."""
    known = comp.select(F.col("node").alias("id"), F.col("component").alias("c"))
    now = cut(trie.drop("comp").join(growing(known), "id", "left").select("key", "path", "id", F.coalesce("c", "id").alias("comp")))
    mixed = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi")
    return skewed(now, mixed.select("key", "n"), ["key"], "n").select("key", "path", "id", "comp")


def first_of_bucket(trie: DataFrame, steps: int) -> DataFrame:
    """(a, b), a < b: the first record of each prefix, ``steps`` longer than the final one, with those of other groups."""
    longer = trie.withColumn("code", F.shiftrightunsigned("path", (STEPS - steps) * _CODE_BITS))
    firsts = longer.groupBy("key", "code").agg(F.min(F.struct("id", "comp")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = skewed(longer, firsts, ["key", "code"], "n").where("id <> first.id AND comp <> first.comp")
    return met.select(F.col("first.id").alias("a"), F.col("id").alias("b")).distinct()


def strangers(trie: DataFrame, sets: DataFrame, threshold: float, most: int) -> DataFrame:
    """(a, b), a < b: records of different groups that share a prefix of the final depth."""
    by_comp = cut(trie.select("key", "comp").distinct())
    size = by_comp.groupBy("key").agg(F.count(F.lit(1)).alias("groups"))
    full = cut(size.where(F.col("groups") > most).select("key"))
    few = by_comp.join(growing(full), "key", "left_anti")
    pairs = crossed(few, trie)
    if full.isEmpty():
        return pairs
    return pairs.unionByName(by_rare_shingles(trie.join(growing(full), "key", "left_semi").select("id", "comp").distinct(), sets, threshold)).distinct()


def crossed(by_comp: DataFrame, entries: DataFrame) -> DataFrame:
    """(a, b), a < b, of different groups under one key; ``by_comp`` has its groups, ``entries`` (key, comp, id) its records."""
    one, two = by_comp.select("key", F.col("comp").alias("ca")), by_comp.select("key", F.col("comp").alias("cb"))
    groups_met = one.join(two, "key").where("ca < cb")
    x = entries.select("key", F.col("comp").alias("ca"), F.col("id").alias("x"))
    y = entries.select("key", F.col("comp").alias("cb"), F.col("id").alias("y"))
    pairs = groups_met.join(x, ["key", "ca"]).join(y, ["key", "cb"])
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def by_rare_shingles(records: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: all pairs of different groups that can reach the threshold, by prefix filtering.

    Of two sets that similar, each has one of the shared shingles among its
    n - ceil(threshold n) + 1 rarest ones. Shingles that only one group has are
    left out, and boilerplate, which everyone has, is never among the rare ones.
    """
    held = records.join(growing(sets), "id").select("id", "comp", F.size("shingles").alias("n"), F.explode("shingles").alias("key"))
    held = cut(held)
    often = held.groupBy("key").agg(F.count(F.lit(1)).alias("often"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    order = Window.partitionBy("id").orderBy("often", "key")  # as long as one text
    placed = held.join(growing(often), "key").withColumn("place", F.row_number().over(order))
    rare = cut(placed.where((F.col("place") <= F.col("n") - F.ceil(F.col("n") * F.lit(threshold - 1e-9)) + 1) & (F.col("lo") != F.col("hi"))).select("key", "comp", "id"))
    return crossed(rare.select("key", "comp").distinct(), rare)


def opening_text(ashby: DataFrame) -> DataFrame:
    """(row_id, text) of the rows with a description: title, company and it."""
    blank = F.coalesce(F.trim(F.regexp_replace("description_plain", r"\s+", " ")), F.lit("")) == ""
    return ashby.where(~blank).select("row_id", F.concat_ws(" ", "title", "company", "description_plain").alias("text"))


def opening_groups(ashby: DataFrame) -> DataFrame:
    """(row_id, group) of openings: three words, a similarity of 0.6 or more."""
    return groups(opening_text(ashby), "row_id", "text", width=3, threshold=0.6)


def pairs_within(grouped: DataFrame, key: str = "row_id") -> DataFrame:
    """(row_a, row_b), row_a < row_b, of the rows of one group; the result is as long as that says."""
    several = grouped.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group")
    held = grouped.join(several, "group")
    a, b = held.select("group", F.col(key).alias("row_a")), held.select("group", F.col(key).alias("row_b"))
    return a.join(b, "group").where("row_a < row_b").select("row_a", "row_b")


def opening_classes(spark: SparkSession, d: str) -> DataFrame:
    """p2_groups: one row per opening row with its class and the class's number of rows."""
    grouped = cut(opening_groups(table(spark, d, "ashby_jobs")))
    n = grouped.groupBy("group").agg(F.count(F.lit(1)).alias("n_rows"))
    return skewed(grouped, n, ["group"], "n_rows").select("row_id", F.col("group").alias("class_id"), "n_rows")


def found(spark: SparkSession, d: str) -> DataFrame:
    """p2_found."""
    return pairs_within(cut(opening_groups(table(spark, d, "ashby_jobs"))))
