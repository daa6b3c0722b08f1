"""Recorded board listings to one canonical posting schema, by projection of nested columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.functions.html import html_to_text
from lathe.functions.ids import fingerprint, stable_id
from lathe.functions.text import clean_block, clean_line, search_document, search_key
from lathe.functions.urls import canonical_url

PLACE = "struct<name:string,locality:string,region:string,country:string>"
COMPONENT = "struct<kind:string,label:string,currency:string,min:double,max:double,interval:string>"

#: What every source is projected to.
POSTING = (
    "source_kind string, source_instance string, source_job_id string, url string, apply_url string, company string, title string, department string, team string, "
    f"location string, locations array<{PLACE}>, employment_type string, workplace_type string, is_remote boolean, compensation struct<summary:string,components:array<{COMPONENT}>>, "
    "description_text string, posted_at timestamp, source_updated_at timestamp"
)

ASHBY = (
    "jobs array<struct<id:string,title:string,department:string,team:string,employmentType:string,location:string,secondaryLocations:array<struct<location:string,"
    "address:struct<postalAddress:struct<addressLocality:string,addressRegion:string,addressCountry:string>>>>,publishedAt:string,isListed:boolean,isRemote:boolean,workplaceType:string,"
    "jobUrl:string,applyUrl:string,descriptionHtml:string,descriptionPlain:string,compensation:struct<compensationTierSummary:string,summaryComponents:array<struct<compensationType:string,"
    "interval:string,currencyCode:string,minValue:double,maxValue:double,summary:string>>>>>"
)
GREENHOUSE = (
    "jobs array<struct<id:bigint,title:string,company_name:string,absolute_url:string,location:struct<name:string>,first_published:string,updated_at:string,departments:array<struct<name:string>>,"
    "offices:array<struct<name:string,location:string>>,metadata:array<struct<name:string,value:string>>,pay_input_ranges:array<struct<min_cents:bigint,max_cents:bigint,currency_type:string,title:string>>,"
    "content:string>>, meta struct<total:int>"
)
LEVER = (
    "array<struct<id:string,text:string,categories:struct<team:string,department:string,location:string,commitment:string,allLocations:array<string>>,createdAt:bigint,hostedUrl:string,applyUrl:string,"
    "workplaceType:string,descriptionPlain:string,lists:array<struct<text:string,content:string>>,additionalPlain:string,salaryRange:struct<currency:string,interval:string,min:double,max:double>>>"
)


def labelled(c, table: dict[str, str]):
    """Code of a free label by its search key; unknown labels stay as they are."""
    key = search_key(c)
    out = clean_line(c)
    for words, code in table.items():
        out = F.when(key.isin(words.split("|")), F.lit(code)).otherwise(out)
    return out


# Labels of employment and workplace by their search keys.
EMPLOYMENT = {"full time|fulltime|permanent": "full_time", "part time|parttime": "part_time", "contract|contractor|freelance": "contract", "intern|internship": "internship", "temporary|temp": "temporary"}
WORKPLACE = {"remote|fully remote": "remote", "hybrid": "hybrid", "on site|onsite|in office|office": "onsite"}


def _place(name, locality=None, region=None, country=None):
    null = F.lit(None).cast("string")
    return F.struct(clean_line(name).alias("name"), (locality if locality is not None else null).alias("locality"), (region if region is not None else null).alias("region"), (country if country is not None else null).alias("country"))


def ashby(listings: DataFrame) -> DataFrame:
    """Postings of listings (source_instance, body string): unlisted ones are left out."""
    j = listings.select("source_instance", F.from_json("body", ASHBY).alias("b")).select("source_instance", F.explode("b.jobs").alias("j")).where("coalesce(j.isListed, true)")
    extra = F.transform("j.secondaryLocations", lambda x: _place(x["location"], x["address"]["postalAddress"]["addressLocality"], x["address"]["postalAddress"]["addressRegion"], x["address"]["postalAddress"]["addressCountry"]))
    kind = lambda t: F.when(F.lower(t).contains("equity"), "equity_percentage").when(F.lower(t).contains("bonus"), "bonus").otherwise("salary")
    parts = F.transform(
        "j.compensation.summaryComponents",
        lambda x: F.struct(kind(x["compensationType"]).alias("kind"), x["summary"].alias("label"), x["currencyCode"].alias("currency"), x["minValue"].alias("min"), x["maxValue"].alias("max"), x["interval"].alias("interval")),
    )
    return _posting(
        j, "ashby", id=F.col("j.id"), url=F.col("j.jobUrl"), apply_url=F.col("j.applyUrl"), company=F.col("source_instance"), title=F.col("j.title"), department=F.col("j.department"), team=F.col("j.team"),
        location=F.col("j.location"), locations=F.concat(F.array(_place(F.col("j.location"))), F.coalesce(extra, F.array().cast(f"array<{PLACE}>"))),
        employment=F.col("j.employmentType"), workplace=F.col("j.workplaceType"), remote=F.col("j.isRemote"),
        compensation=F.when(F.col("j.compensation").isNotNull(), F.struct(F.col("j.compensation.compensationTierSummary").alias("summary"), parts.alias("components"))),
        description=F.coalesce(clean_block("j.descriptionPlain"), html_to_text(F.col("j.descriptionHtml"))), posted=F.col("j.publishedAt").try_cast("timestamp"), updated=F.lit(None).cast("timestamp"),
    )


def greenhouse(listings: DataFrame) -> DataFrame:
    """Postings of listings (source_instance, body string); content is markup escaped once more."""
    j = listings.select("source_instance", F.from_json("body", GREENHOUSE).alias("b")).select("source_instance", F.explode("b.jobs").alias("j"))
    meta = lambda words: F.get(F.filter("j.metadata", lambda m: search_key(m["name"]).isin(words)), F.lit(0))["value"]
    parts = F.transform(
        "j.pay_input_ranges",
        lambda x: F.struct(F.lit("salary").alias("kind"), x["title"].alias("label"), x["currency_type"].alias("currency"), (x["min_cents"] / 100).alias("min"), (x["max_cents"] / 100).alias("max"), F.lit(None).cast("string").alias("interval")),
    )
    return _posting(
        j, "greenhouse", id=F.col("j.id").cast("string"), url=F.col("j.absolute_url"), apply_url=F.lit(None).cast("string"), company=F.coalesce(F.col("j.company_name"), F.col("source_instance")),
        title=F.col("j.title"), department=F.get(F.col("j.departments"), F.lit(0))["name"], team=F.lit(None).cast("string"), location=F.col("j.location.name"),
        locations=F.array(_place(F.col("j.location.name"))), employment=meta(["employment type", "time type"]), workplace=meta(["workplace type", "location type"]), remote=F.lit(None).cast("boolean"),
        compensation=F.when(F.size("j.pay_input_ranges") > 0, F.struct(F.lit(None).cast("string").alias("summary"), parts.alias("components"))),
        description=html_to_text(F.col("j.content"), escaped=True), posted=F.col("j.first_published").try_cast("timestamp"), updated=F.col("j.updated_at").try_cast("timestamp"),
    )


def lever(listings: DataFrame) -> DataFrame:
    """Postings of listings (source_instance, body string): lists become sections of the description."""
    j = listings.select("source_instance", F.explode(F.from_json("body", LEVER)).alias("j"))
    sections = F.transform("j.lists", lambda x: F.concat(F.lit("<h3>"), F.coalesce(x["text"], F.lit("")), F.lit("</h3><ul>"), F.coalesce(x["content"], F.lit("")), F.lit("</ul>")))
    markup = F.concat(F.coalesce("j.descriptionPlain", F.lit("")), F.array_join(F.coalesce(sections, F.array().cast("array<string>")), ""), F.coalesce("j.additionalPlain", F.lit("")))
    pay = F.struct(F.lit("salary").alias("kind"), F.lit(None).cast("string").alias("label"), F.col("j.salaryRange.currency").alias("currency"), F.col("j.salaryRange.min").alias("min"), F.col("j.salaryRange.max").alias("max"), F.col("j.salaryRange.interval").alias("interval"))
    return _posting(
        j, "lever", id=F.col("j.id"), url=F.col("j.hostedUrl"), apply_url=F.col("j.applyUrl"), company=F.col("source_instance"), title=F.col("j.text"), department=F.col("j.categories.department"),
        team=F.col("j.categories.team"), location=F.col("j.categories.location"), locations=F.transform(F.coalesce(F.col("j.categories.allLocations"), F.array("j.categories.location")), lambda x: _place(x)),
        employment=F.col("j.categories.commitment"), workplace=F.col("j.workplaceType"), remote=F.lit(None).cast("boolean"),
        compensation=F.when(F.col("j.salaryRange").isNotNull(), F.struct(F.lit(None).cast("string").alias("summary"), F.array(pay).alias("components"))),
        description=html_to_text(markup), posted=F.timestamp_millis("j.createdAt"), updated=F.lit(None).cast("timestamp"),
    )


def _posting(df, kind, *, id, url, apply_url, company, title, department, team, location, locations, employment, workplace, remote, compensation, description, posted, updated) -> DataFrame:  # noqa: A002
    columns = {
        "source_kind": F.lit(kind), "source_instance": F.col("source_instance"), "source_job_id": id, "url": canonical_url(url), "apply_url": canonical_url(apply_url), "company": clean_line(company), "title": clean_line(title),
        "department": clean_line(department), "team": clean_line(team), "location": clean_line(location), "locations": F.filter(locations, lambda x: x["name"].isNotNull()), "employment_type": labelled(employment, EMPLOYMENT),
        "workplace_type": labelled(workplace, WORKPLACE), "is_remote": remote, "compensation": compensation, "description_text": description, "posted_at": posted, "source_updated_at": updated,
    }
    return df.select(*[v.alias(k) for k, v in columns.items()])


def completeness(listings: DataFrame, kind: str) -> DataFrame:
    """(source_instance, received, complete): a listing is partial when its own total disagrees with its count."""
    if kind == "greenhouse":
        b = F.from_json("body", GREENHOUSE)
        n = F.coalesce(F.size(b["jobs"]), F.lit(0))
        return listings.select("source_instance", n.alias("received"), (b["jobs"].isNotNull() & (F.coalesce(b["meta"]["total"], n) == n)).alias("complete"))
    b = F.from_json("body", LEVER) if kind == "lever" else F.from_json("body", ASHBY)["jobs"]
    return listings.select("source_instance", F.coalesce(F.size(b), F.lit(0)).alias("received"), b.isNotNull().alias("complete"))


def prepared(postings: DataFrame, arrival: str) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) postings with job ids, fingerprints and search documents.

    A posting needs a title, a company and a native id or URL, and finite,
    ordered, non-negative pay. Of one job id the first by ``arrival`` stays.
    """
    from pyspark.sql import Window

    amount = lambda x: x["min"].isNull() | ((x["min"] >= 0) & ~F.isnan(x["min"]))
    wrong = F.exists("compensation.components", lambda x: ~(amount(x) & (x["max"].isNull() | (x["max"] >= F.coalesce(x["min"], F.lit(0.0))))))
    reason = (
        F.when(F.col("title").isNull(), "no title").when(F.col("company").isNull(), "no company")
        .when(F.col("source_job_id").isNull() & F.col("url").isNull(), "no identity").when(F.coalesce(wrong, F.lit(False)), "bad pay")
    )
    key = F.coalesce(F.col("source_job_id"), F.col("url"))
    df = postings.withColumn("reason", reason).withColumn("job_id", stable_id("job", F.concat_ws(":", "source_kind", "source_instance"), key, prefix="job_"))
    first = Window.partitionBy("job_id").orderBy(arrival)
    material = {c: F.col(c) for c in ("title", "company", "department", "team", "location", "employment_type", "workplace_type", "is_remote")} | {"pay": F.to_json("compensation"), "places": F.to_json("locations")}
    good = df.where("reason IS NULL").withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "reason")
    good = good.withColumn("fingerprint", fingerprint(material | {"text": F.col("description_text")})).withColumn("content_fingerprint", fingerprint({"text": F.col("description_text")}))
    good = good.withColumn("search_text", search_document("title", "company", "department", "team", "location", "workplace_type"))
    return good, df.where("reason IS NOT NULL")


def read_linkedin(spark: SparkSession, path: str) -> DataFrame:
    """Positions of a LinkedIn export: quoted cells may hold line ends."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.select(*[clean_block(F.col(f"`{c}`")).alias(c.lstrip("﻿").strip().lower().replace(" ", "_")) for c in df.columns])


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """Countries of a tab-separated list: code, name, continent, population, zones and other names; lines after # are notes."""
    raw = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.split("value", "\t").alias("c"))
    many = lambda i: F.filter(F.split(F.coalesce(F.get("c", F.lit(i)), F.lit("")), r"[;,]"), lambda x: x != "")
    return raw.select(F.get("c", F.lit(0)).alias("code"), F.get("c", F.lit(1)).alias("name"), F.get("c", F.lit(2)).alias("continent"), F.get("c", F.lit(3)).try_cast("long").alias("population"), many(4).alias("zones"), many(5).alias("other_names"))


def read_leads(spark: SparkSession, path: str, form: str) -> DataFrame:
    """(name, url, note) of leads in csv, json lines or plain lines, under the names that exports use."""
    names = {"name": ["name", "company", "title"], "url": ["url", "website", "link", "homepage"], "note": ["note", "notes", "description"]}
    if form == "plain":
        df = spark.read.text(path).where(F.trim("value") != "")
        url = F.regexp_extract("value", r"(https?://\S+)", 1)
        return df.select(clean_line(F.regexp_replace("value", r"https?://\S+", " ")).alias("name"), F.nullif(url, F.lit("")).alias("url"), F.lit(None).cast("string").alias("note"))
    df = spark.read.option("header", True).csv(path) if form == "csv" else spark.read.json(path)
    have = {c.lower(): c for c in df.columns}
    pick = lambda ns: F.coalesce(*[clean_line(F.col(f"`{have[n]}`").cast("string")) for n in ns if n in have], F.lit(None).cast("string"))
    return df.select(*[pick(v).alias(k) for k, v in names.items()])
