"""The four timestamp fields of the job tables, each as one UTC instant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.functions.timestamps import parse_instants
from lathe.session import bounded_broadcast


def field_values(df: DataFrame, tbl: str, fields: list[str], board: str | None) -> DataFrame:
    """(tbl, row_id, field, value, board): the table is read once for all fields."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    named = F.col(board) if board else F.lit(None).cast("string")
    return df.select(F.lit(tbl).alias("tbl"), "row_id", named.alias("board"), F.explode(pairs).alias("x")).select("tbl", "row_id", "board", "x.*")


def instants(greenhouse: DataFrame, ashby: DataFrame, linkedin: DataFrame, boards: DataFrame) -> DataFrame:
    """(tbl, row_id, field, instant_us) of every value that names an instant or date.

    Values of boards that are not listed, and of positions, are UTC wall time.
    """
    values = (
        field_values(greenhouse, "greenhouse_jobs", ["first_published", "updated_at"], "board")
        .unionByName(field_values(ashby, "ashby_jobs", ["published_at"], "board"))
        .unionByName(field_values(linkedin, "linkedin_positions", ["started_on"], None))
        .where("value IS NOT NULL")
    )
    rules = boards.groupBy("board").agg(F.first("zone").alias("zone"), (F.first("date_order") != "mdy").alias("day_first"))
    placed = values.join(bounded_broadcast(rules), "board", "left")
    return parse_instants(placed, "value", "zone", "day_first").where("instant_us IS NOT NULL").select("tbl", "row_id", "field", "instant_us")
