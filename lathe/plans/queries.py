"""Core queries by name: callables of (spark, folder)."""

from __future__ import annotations

from lathe.operators import instants as op_instants
from lathe.operators import quantities, snapshots, splitting
from lathe.plans import core_sql, general, ledger, people, places, sources
from lathe.session import table


def p4_found(spark, d):
    """Changes between consecutive complete scans."""
    return snapshots.changes(table(spark, d, "stored_jobs"), table(spark, d, "source_scans"))


def p5_found(spark, d):
    """UTC instants of the four timestamp fields."""
    return op_instants.instants(*[table(spark, d, t) for t in ("greenhouse_jobs", "ashby_jobs", "linkedin_positions", "boards")])


QUERIES = {
    "p3_found": quantities.found,
    "p3_review": quantities.review,
    "p3_predictions": quantities.predictions,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p6_found": splitting.found,
    **general.QUERIES,
    **ledger.QUERIES,
    **places.QUERIES,
    **sources.QUERIES,
    **people.QUERIES,
}
SQL = {"p4_found": core_sql.P4_FOUND, "p5_found": core_sql.P5_FOUND, **general.SQL, **ledger.SQL, **places.SQL, **sources.SQL, **people.SQL}
