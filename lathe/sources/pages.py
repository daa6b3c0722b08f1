"""Listings that come as pages: a company's jobs in the data attribute of a page, and board links in any page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.functions.html import absolute_urls, decode
from lathe.functions.text import clean_block, clean_line
from lathe.functions.urls import board_reference
from lathe.sources.boards import PLACE, _posting

_JOB = "id:string,title:string,url:string,applyUrl:string,location:string,type:string,prettyRole:string,salaryRange:string,equityRange:string,description:string"
LISTING = f"component string, props struct<company:struct<name:string>,jobPostings:array<struct<{_JOB}>>,job:struct<{_JOB}>>"


def page_data(page: Column | str) -> Column:
    """The JSON in a page's data-page attribute, its references decoded; null without one."""
    c = F.col(page) if isinstance(page, str) else page
    raw = F.nullif(F.regexp_extract(c, r'data-page="([^"]*)"', 1), F.lit(""))

    @F.pandas_udf("string")
    def run(s):
        return s.map(lambda x: None if x is None else decode(x))

    return run(raw)


def listed(pages: DataFrame) -> DataFrame:
    """(source_instance, company, id, path, reason) of the jobs of listing pages (source_instance, body).

    A job needs an id and a path under its company's own; the others have a reason.
    """
    p = pages.select("source_instance", F.from_json(page_data("body"), LISTING).alias("p")).where("p.component = 'WaasShowJobsPage'")
    j = p.select("source_instance", F.coalesce(clean_line("p.props.company.name"), F.col("source_instance")).alias("company"), F.explode("p.props.jobPostings").alias("j"))
    path = F.trim("j.url")
    fits = F.coalesce(F.startswith(path, F.concat(F.lit("/companies/"), "source_instance", F.lit("/jobs/"))), F.lit(False))
    reason = F.when(F.col("j.id").isNull(), "no identity").when(~fits, "no path of the company")
    return j.select("source_instance", "company", F.col("j.id").alias("id"), path.alias("path"), reason.alias("reason"))


def yc(pages: DataFrame, site: str = "https://www.ycombinator.com") -> DataFrame:
    """Postings of job pages (source_instance, company, body): places are parted by slashes, pay is a short range."""
    j = pages.select("source_instance", "company", F.from_json(page_data("body"), LISTING)["props"]["job"].alias("j")).where("j.id IS NOT NULL")
    options = F.filter(F.transform(F.split(F.coalesce("j.location", F.lit("")), " / "), lambda o: F.trim(o)), lambda o: o != "")
    low = F.transform(options, lambda o: F.lower(o))
    every = lambda word: (F.size(options) > 0) & F.forall(low, lambda o: F.startswith(o, F.lit(word)))

    def place(o):
        parts = F.transform(F.split(o, ","), lambda x: F.trim(x))
        three = (F.size(parts) == 3) & ~F.contains(o, F.lit("(")) & F.forall(parts, lambda x: x != "")
        part = lambda i: F.when(three, F.get(parts, F.lit(i)))
        return F.struct(o.alias("name"), part(0).alias("locality"), part(1).alias("region"), part(2).alias("country"))

    number = lambda text, i: F.regexp_extract(text, r"([\d.]+)\s*[KkMm]?\s*%?\s*[-–—]\s*(?:US)?\$?\s*([\d.]+)", i).try_cast("double")
    scale = F.when(F.lower("j.salaryRange").rlike(r"\d\s*m\b"), 1e6).when(F.lower("j.salaryRange").rlike(r"\d\s*k\b"), 1e3).otherwise(1.0)
    none = F.lit(None).cast("string")
    currency = F.when(F.col("j.salaryRange").contains("US$"), "USD").when(F.col("j.salaryRange").contains("€"), "EUR").when(F.col("j.salaryRange").contains("£"), "GBP")
    pay = F.struct(F.lit("salary").alias("kind"), none.alias("label"), currency.alias("currency"), (number("j.salaryRange", 1) * scale).alias("min"), (number("j.salaryRange", 2) * scale).alias("max"), none.alias("interval"))
    equity = F.struct(F.lit("equity_percentage").alias("kind"), none.alias("label"), none.alias("currency"), number("j.equityRange", 1).alias("min"), number("j.equityRange", 2).alias("max"), none.alias("interval"))
    summary = F.nullif(F.concat_ws(" • ", clean_line("j.salaryRange"), F.concat(clean_line("j.equityRange"), F.lit(" equity"))), F.lit(""))
    url = F.when(F.startswith(F.trim("j.url"), F.lit("/")), F.concat(F.lit(site), F.trim("j.url"))).otherwise(F.trim("j.url"))
    apply_url = F.coalesce(F.try_url_decode(F.nullif(F.regexp_extract("j.applyUrl", r"[?&]continue=([^&#]+)", 1), F.lit(""))), F.col("j.applyUrl"))
    return _posting(
        j, "yc", id=F.col("j.id"), url=url, apply_url=F.coalesce(apply_url, F.lit("")), company=F.col("company"), title=F.col("j.title"), department=F.col("j.prettyRole"), team=none, location=F.col("j.location"),
        locations=F.transform(options, place).cast(f"array<{PLACE}>"), employment=F.col("j.type"), workplace=F.when(every("remote"), "remote").when(every("hybrid"), "hybrid"),
        remote=F.when(F.exists(low, lambda o: F.startswith(o, F.lit("remote"))), F.lit(True)),
        compensation=F.when(summary.isNotNull(), F.struct(summary.alias("summary"), F.filter(F.array(pay, equity), lambda x: x["min"].isNotNull()).alias("components"))),
        description=clean_block("j.description"), posted=F.lit(None).cast("timestamp"), updated=F.lit(None).cast("timestamp"),
    )


def board_links(page: Column | str) -> Column:
    """array<struct<system,board>>: boards that a page links to, each once, in order."""
    return F.array_distinct(F.array_compact(F.transform(absolute_urls(page), board_reference)))
