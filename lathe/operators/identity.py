"""The same opportunity across sources: evidence edges, vetoes, constrained components."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.functions.text import search_key, titles_compatible
from lathe.operators.graph import connected_components
from lathe.session import Rewritten, cut, growing


def evidence(records: DataFrame, keys: dict[str, object]) -> DataFrame:
    """(job_id, source, key): distinct evidence keys of each record, kinds as prefixes; null evidence gives none."""
    each = F.array(*[F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{kind}:"), c)) for kind, c in keys.items()])
    return records.select("job_id", "source", F.explode(F.array_distinct(F.array_compact(each))).alias("key"))


def candidate_links(records: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, a, b, accepted): of keys that name one record in each of two or more sources, links from the first source's record.

    Ambiguous keys, with two records of one source, are dropped; a link whose
    titles do not agree is vetoed. Each key yields a star, never all pairs.
    """
    per = edges.groupBy("key", "source").agg(F.count(F.lit(1)).alias("n"), F.min("job_id").alias("job_id"))
    keys = per.groupBy("key").agg(F.count(F.lit(1)).alias("sources"), F.max("n").alias("most"), F.min_by("job_id", "source").alias("a")).where("sources > 1 AND most = 1")
    star = per.join(keys, "key").where("job_id <> a").select("key", "a", F.col("job_id").alias("b"), "source")
    t = records.select("job_id", "title")
    named = star.join(t.withColumnsRenamed({"job_id": "a", "title": "ta"}), "a").join(t.withColumnsRenamed({"job_id": "b", "title": "tb"}), "b")
    return named.select("key", "a", "b", titles_compatible("ta", "tb").alias("accepted"))


#: Records of a component that one task joins; larger components are joined by rounds of all tasks.
MOST_MEMBERS = 10_000


def groups(records: DataFrame, links: DataFrame, most: int = MOST_MEMBERS) -> DataFrame:
    """(job_id, founder): records joined by accepted links, at most one record of a source in a group.

    Plain components bound the work; inside one, links are taken in the order of
    their key and refused where a source would meet itself. The founder is the
    record first seen, then of the least id. A component of up to ``most``
    records is one task's; in larger ones the links that come first at both of
    their ends are decided together, round by round, with the same result.
    """
    good = links.where("accepted")
    comp = cut(connected_components(good, "a", "b"))
    sizes = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    large = cut(sizes.where(F.col("n") > most).select("component"))
    nodes = records.select("job_id", "source", "first_seen_at")
    known = comp.select(F.col("node").alias("job_id"), "component")
    if not large.isEmpty():
        big = cut(nodes.join(known.join(growing(large), "component", "left_semi"), "job_id"))
        theirs = good.join(big.select(F.col("job_id").alias("a")), "a", "left_semi")
        wide = _by_rounds(big.drop("component"), theirs)
        known = known.join(growing(large), "component", "left_anti")
        good = good.join(big.select(F.col("job_id").alias("a")), "a", "left_anti")
    members = nodes.join(known, "job_id").select("component", "job_id", "source", "first_seen_at")
    edge = good.join(known.select(F.col("job_id").alias("a"), F.col("component").alias("within")), "a").select("within", "key", "a", "b")

    def merge(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        root = {j: j for j in left["job_id"]}
        of = {j: {s} for j, s in zip(left["job_id"], left["source"], strict=True)}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for _, a, b in sorted(zip(right["key"], right["a"], right["b"], strict=True)):
            x, y = find(a), find(b)
            if x != y and not of[x] & of[y]:
                root[y] = x
                of[x] |= of.pop(y)
        seen = dict(zip(left["job_id"], zip(left["first_seen_at"], left["job_id"], strict=True), strict=True))
        first: dict = {}
        for j in root:
            r = find(j)
            first[r] = min(first.get(r, seen[j]), seen[j])
        return pd.DataFrame({"job_id": list(root), "founder": [first[find(j)][1] for j in root]})

    kind = dict(records.dtypes)["job_id"]
    out = members.groupBy("component").cogroup(edge.groupBy("within")).applyInPandas(merge, f"job_id {kind}, founder {kind}")
    if not large.isEmpty():
        out = out.unionByName(wide)
    return nodes.join(out, "job_id", "left").select("job_id", F.coalesce("founder", "job_id").alias("founder"))


def _by_rounds(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(job_id, founder) of ``groups`` for components of any size.

    A link's fate depends only on earlier links at the two groups that it joins;
    so in each round every group names its first open link, and a link that both
    of its groups name is decided: taken if they share no source, else dropped.
    """
    members = Rewritten(nodes.select("job_id", "source", F.col("job_id").alias("grp")))
    waiting = Rewritten(links.select("key", "a", "b").distinct())
    decided = Rewritten(waiting.df.limit(0).withColumns({"ga": F.col("a"), "gb": F.col("b")}))
    while not waiting.df.isEmpty():
        member, of = members.df, members.df.select("job_id", "grp")
        e = waiting.df.join(growing(of.withColumnsRenamed({"job_id": "a", "grp": "ga"})), "a").join(growing(of.withColumnsRenamed({"job_id": "b", "grp": "gb"})), "b").where("ga <> gb")
        link = F.struct("key", "a", "b")
        first = e.select(link.alias("link"), F.explode(F.array("ga", "gb")).alias("grp")).groupBy("grp").agg(F.min("link").alias("first"))
        named = first.groupBy(F.col("first").alias("link")).agg(F.count(F.lit(1)).alias("ends")).where("ends = 2").select("link.*")
        chosen = decided.write(e.join(growing(named), ["key", "a", "b"], "left_semi").select("key", "a", "b", "ga", "gb"))
        sources = member.select("grp", "source").distinct()
        met = chosen.join(growing(sources.withColumnRenamed("grp", "ga")), "ga").join(growing(sources.withColumnRenamed("grp", "gb")), ["gb", "source"]).select("key", "a", "b").distinct()
        taken = chosen.join(growing(met), ["key", "a", "b"], "left_anti").select(F.greatest("ga", "gb").alias("grp"), F.least("ga", "gb").alias("into"))
        still = e.select("key", "a", "b").join(growing(chosen.select("key", "a", "b")), ["key", "a", "b"], "left_anti")
        waiting.write(still)
        members.write(member.join(growing(taken), "grp", "left").select("job_id", "source", F.coalesce("into", "grp").alias("grp")))
    member = members.df
    first = nodes.join(growing(member.select("job_id", "grp")), "job_id")
    founders = first.groupBy("grp").agg(F.min_by("job_id", F.struct("first_seen_at", "job_id")).alias("founder"))
    return member.select("job_id", "grp").join(growing(founders), "grp").select("job_id", "founder")


def reassigned(labels: DataFrame, key: str, was: str, now: str) -> DataFrame:
    """(key, now) of the records whose label changes; null is a label of its own."""
    return labels.where(~F.col(was).eqNullSafe(F.col(now))).select(key, now)


def look_alikes(records: DataFrame, grouped: DataFrame) -> DataFrame:
    """(company_key, title_key, n_jobs): equal names in several sources and several groups."""
    df = records.join(grouped, "job_id").select("job_id", "source", "founder", search_key("company").alias("company_key"), search_key("title").alias("title_key"))
    df = df.where("company_key <> '' AND title_key <> ''").groupBy("company_key", "title_key")
    counts = df.agg(F.countDistinct("source").alias("sources"), F.countDistinct("founder").alias("groups"), F.count(F.lit(1)).alias("n_jobs"))
    return counts.where("sources > 1 AND groups > 1").select("company_key", "title_key", "n_jobs")
