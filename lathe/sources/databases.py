"""Tables of databases, read in ranges of a key so that every task reads its own part."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def read_sqlite(spark: SparkSession, path: str, name: str, schema: str, parts: int = 8) -> DataFrame:
    """A table of an SQLite file that all executors can reach: ranges of rowid are read by one task each.

    Only the columns of ``schema`` are read; the file is opened read-only.
    """
    import sqlite3

    columns = [c.strip().split()[0] for c in schema.split(",")]
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
        lo, hi = c.execute(f'SELECT min(rowid), max(rowid) FROM "{name}"').fetchone()
    if lo is None:
        return spark.createDataFrame([], schema)
    width = (hi - lo) // parts + 1
    ranges = [(lo + i * width, min(lo + (i + 1) * width - 1, hi)) for i in range(parts) if lo + i * width <= hi]
    selected = ", ".join(f'"{c}"' for c in columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for x, y in zip(b["lo"], b["hi"], strict=True):
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
                    rows = c.execute(f'SELECT {selected} FROM "{name}" WHERE rowid BETWEEN ? AND ?', (int(x), int(y)))
                    while chunk := rows.fetchmany(50_000):
                        yield pd.DataFrame(chunk, columns=columns)

    return spark.createDataFrame(ranges, "lo long, hi long").repartition(len(ranges), "lo").mapInPandas(run, schema)


def read_jdbc(spark: SparkSession, url: str, name: str, key: str, lo: int, hi: int, parts: int = 32, **options: str) -> DataFrame:
    """A table over JDBC (PostgreSQL and others whose driver is on the class path), in ranges of an integer key; filters and columns are pushed down."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).option("partitionColumn", key).option("lowerBound", str(lo)).option("upperBound", str(hi)).option("numPartitions", str(parts))
    for k, v in {"fetchsize": "10000", **options}.items():
        reader = reader.option(k, v)
    return reader.load()
