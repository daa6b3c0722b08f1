"""People's own sources: professional-network exports, code-host profiles, resumes, and profile documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lathe.functions.text import clean_block, clean_line, search_key
from lathe.operators.records import date_ranges
from lathe.sources.boards import read_linkedin

# Files of an export, headings of resume sections by their search keys.
EXPORT_FILES = ["Positions", "Education", "Skills", "Projects", "Profile", "Certifications", "Languages"]
HEADINGS = {
    "experience": "experience|work experience|employment|employment history|professional experience", "education": "education|academic background", "skills": "skills|technical skills|technologies",
    "projects": "projects|selected projects|side projects", "summary": "summary|profile|about|about me", "languages": "languages", "certifications": "certifications|certificates",
}

REPOSITORIES = "name string, full_name string, owner string, private boolean, fork boolean, archived boolean, size long, pushed_at string, language string, languages map<string,long>, topics array<string>, description string"


def read_export(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of an unpacked export by file name in lower case; files that are not there are left out."""
    from pathlib import Path

    return {n.lower(): read_linkedin(spark, str(Path(folder) / f"{n}.csv")) for n in EXPORT_FILES if (Path(folder) / f"{n}.csv").exists()}


def export_records(tables: dict[str, DataFrame]) -> DataFrame:
    """(kind, name, detail, started_on, finished_on): all records of an export in one table."""
    names = {"positions": ("title", "company_name"), "education": ("school_name", "degree_name"), "skills": ("name", None), "projects": ("title", "description"), "certifications": ("name", "authority"), "languages": ("name", "proficiency")}
    null = F.lit(None).cast("string")
    parts = []
    for kind, df in tables.items():
        if kind not in names:
            continue
        c = lambda n, df=df: clean_line(n) if n and n in df.columns else null
        first, second = names[kind]
        start = next((n for n in ("started_on", "start_date") if n in df.columns), None)
        end = next((n for n in ("finished_on", "end_date") if n in df.columns), None)
        parts.append(df.select(F.lit(kind).alias("kind"), c(first).alias("name"), c(second).alias("detail"), c(start).alias("started_on"), c(end).alias("finished_on")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("name IS NOT NULL")


def read_repositories(spark: SparkSession, path: str) -> DataFrame:
    """Repositories of recorded code-host profiles in JSON lines."""
    return spark.read.schema(REPOSITORIES).json(path)


def selected_repositories(repositories: DataFrame, most: int) -> DataFrame:
    """The owner's own repositories, newest push first, at most ``most`` of an owner: no private, forked or empty ones, and not the profile's own."""
    own = repositories.where("NOT coalesce(private, false) AND NOT coalesce(fork, false) AND coalesce(size, 0) > 0 AND lower(name) <> lower(owner)")
    order = Window.partitionBy(F.lower("owner")).orderBy(F.desc_nulls_last("pushed_at"), F.lower("full_name"))
    return own.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def language_shares(languages: Column | str, least: float = 0.1, most: int = 3) -> Column:
    """array<struct<share,language>>: a repository's main languages, largest first, in whole percent."""
    c = F.col(languages) if isinstance(languages, str) else languages
    total = F.aggregate(F.map_values(c), F.lit(0).cast("long"), lambda a, x: a + x)
    each = F.transform(F.map_entries(c), lambda e: F.struct((e["value"] / total).alias("share"), e["key"].alias("language")))
    ranked = F.sort_array(F.filter(each, lambda e: e["share"] >= least), asc=False)
    return F.transform(F.slice(ranked, 1, most), lambda e: F.struct(F.round(e["share"] * 100).cast("int").alias("share"), e["language"].alias("language")))


def read_resumes(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of resumes in plain text or Markdown, each file one row; marks of headings and emphasis are taken off."""
    df = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    plain = F.regexp_replace(F.regexp_replace("text", r"(?m)^#{1,6}\s+", ""), r"(\*\*|__)(.+?)\1", "$2")
    return df.select("path", clean_block(F.regexp_replace(plain, r"\[([^\]]+)\]\((https?://[^)\s]+)\)", "$1 ($2)")).alias("text"))


def resume_sections(resumes: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, section, pos, line): lines of a resume under the section whose heading came last; lines before any are ``head``."""
    lines = resumes.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).where(F.trim("line") != "")
    k = search_key("line")
    heading = F.lit(None).cast("string")
    for name, words in HEADINGS.items():
        heading = F.when(k.isin(words.split("|")), F.lit(name)).otherwise(heading)
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)  # one resume
    out = lines.withColumn("__h", heading).withColumn("section", F.coalesce(F.last("__h", ignorenulls=True).over(w), F.lit("head")))
    return out.where("__h IS NULL").select(key, "section", "pos", clean_line("line").alias("line"))


def resume_positions(sections: DataFrame, key: str = "path") -> DataFrame:
    """(key, pos, title, company, period) of the lines of experience that name a period: "Title, Company  Mar 2021 - Present" and its like."""
    e = sections.where("section = 'experience'").withColumn("periods", date_ranges(F.col("line"))).where("size(periods) > 0")
    rest = F.regexp_replace(F.replace("line", F.get("periods", F.lit(0)), F.lit("")), r"^[\s,|(–—-]+|[\s,|()–—-]+$", "")
    parts = F.split(rest, r"\s*(?:\||,| at | – | — | - )\s*", 2)
    return e.select(key, "pos", clean_line(F.get(parts, F.lit(0))).alias("title"), clean_line(F.get(parts, F.lit(1))).alias("company"), F.get("periods", F.lit(0)).alias("period"))


def read_profiles(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Profile documents in JSON, one a file; fields that a document lacks are null, broken ones are left out."""
    return spark.read.schema(schema + ", _broken string").option("multiLine", True).option("columnNameOfCorruptRecord", "_broken").json(path).where("_broken IS NULL").drop("_broken")
