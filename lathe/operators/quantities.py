"""Quantities recorded in different units, each in one common unit.

A calibrated tree ensemble predicts the interval, currency and scale that the
record's own field lacks, from magnitude, source, category and neighbouring
fields. Where a label, a summary or the wording states the unit, that holds and
measures the prediction; elsewhere confident predictions are converted and
uncertain ones are routed for review.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.functions.quantities import INTERVAL_WORDS, PER_YEAR, amounts, measures
from lathe.session import cut, table

#: Labelled rows that train and calibrate the classifiers at most.
SAMPLE_ROWS = 6000
#: Calibrated probability from which a predicted unit is converted.
CONFIDENT = 0.9

#: Values of a neighbouring field that the trees tell apart at most; the sample's rarer ones count as one.
MOST_CODES = 24

TARGETS = ["interval", "currency", "scale"]
CONTEXT = ["source", "instance", "category", "workplace", "equity"]


def _text_amounts(df: DataFrame, text: str, cues: bool, physical: bool) -> DataFrame:
    """Add ``said``: the quantities a text states, one array of structs a row."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            out = []
            for t in batch:
                found = [("pay", *a) for a in amounts(t, cues)]
                if physical:
                    found += [(q, None, None, lo, hi) for q, lo, hi in measures(t)]
                out.append([dict(zip(("quantity", "currency", "interval", "lo", "hi"), f, strict=True)) for f in found])
            yield pd.Series(out)

    kind = "array<struct<quantity:string,currency:string,interval:string,lo:double,hi:double>>"
    return df.withColumn("said", F.pandas_udf(run, kind)(text))


def _none(kind: str, name: str) -> Column:
    return F.lit(None).cast(kind).alias(name)


def interval_of(c: Column) -> Column:
    """Interval that a field or label names: hour, day, week, month or year; else null."""
    low = F.lower(c)
    names = {"hour": r"hour|\bhr\b", "day": r"\bday|daily", "week": r"week", "month": r"month", "year": r"year|annual|annum"}
    out = F.lit(None).cast("string")
    for k in reversed(list(INTERVAL_WORDS)):
        out = F.when(low.rlike(names[k]), F.lit(k)).otherwise(out)
    return out


def scale_of(label: Column) -> Column:
    """Factor that a label names: thousands or hundredths; else null."""
    low = F.lower(label)
    return F.when(low.rlike(r"thousand|000s|,\s*k\b|\(k\)|\bin k\b"), 1000.0).when(low.rlike(r"\bcents?\b|minor unit|pence|paise|grosz"), 0.01)


def record_quantities(records: DataFrame) -> DataFrame:
    """Pay and equity of job_records, in the units stated; unstated ones are null."""
    kinds = lambda pred: F.filter("compensation.components", pred)
    known = lambda x: F.when(~F.isnan(x), x)  # noqa: E731  (NaN says nothing)
    fine = lambda x: known(x["min"]).isNotNull() | known(x["max"]).isNotNull()
    ends = lambda c: (F.coalesce(known(F.col(f"{c}.min")), known(F.col(f"{c}.max"))), F.coalesce(known(F.col(f"{c}.max")), known(F.col(f"{c}.min"))))
    base = records.select(
        F.lit("job_records").alias("tbl"), "row_id", F.col("source.kind").alias("source"), F.col("source.instance").alias("instance"), F.col("employment_type").alias("category"), F.col("workplace_type").alias("workplace"),
        F.col("compensation.summary").alias("summary"),
        F.get(kinds(lambda x: F.lower(x["kind"]).isin("salary", "pay", "base", "wage", "compensation") & fine(x)), F.lit(0)).alias("p"),
        kinds(lambda x: F.lower(x["kind"]).contains("equity") & fine(x)).alias("e"),
    ).where("compensation IS NOT NULL")
    base = _text_amounts(base, "summary", cues=False, physical=False).withColumn("s", F.get("said", F.lit(0)))
    lo, hi = ends("p")
    own_interval, own_currency = interval_of(F.col("p.interval")), F.nullif(F.upper(F.trim("p.currency")), F.lit(""))
    # Beside a summary the amounts of the field show their scale; an amount of the summary is whole.
    times = F.try_divide(F.col("s.lo"), lo)
    shown = F.when(lo.isNull(), 1.0)
    for x in (1.0, 1000.0, 0.01):
        shown = F.coalesce(shown, F.when(times.between(x * 0.99, x * 1.01), F.lit(x)))
    pay = base.where("p IS NOT NULL OR s IS NOT NULL").select(
        "tbl", "row_id", F.lit("pay").alias("quantity"),
        F.coalesce(own_currency, F.col("s.currency")).alias("currency"),
        F.coalesce(interval_of(F.col("p.label")), own_interval, F.col("s.interval")).alias("interval"),
        F.coalesce(scale_of(F.col("p.label")), F.when(F.col("s").isNotNull(), shown)).alias("scale"),
        F.coalesce(lo, F.col("s.lo")).alias("lo"), F.coalesce(hi, F.col("s.hi")).alias("hi"),
        own_currency.alias("own_currency"), own_interval.alias("own_interval"), scale_of(F.col("p.label")).alias("own_scale"),
        "source", "instance", "category", "workplace", (F.size("e") > 0).cast("string").alias("equity"),
    )
    label = F.lower(F.coalesce(F.col("x.label"), F.lit("")))
    ppm = F.when(label.rlike(r"bps|basis"), 100.0).when(label.rlike("fraction|share of"), 1e6).when(label.rlike(r"ppm|per million"), 1.0).otherwise(1e4)
    equity = base.select("tbl", "row_id", "source", "instance", "category", "workplace", F.explode("e").alias("x")).select(
        "tbl", "row_id", F.lit("equity").alias("quantity"), F.lit(None).cast("string").alias("currency"), F.lit(None).cast("string").alias("interval"),
        ppm.alias("scale"), ends("x")[0].alias("lo"), ends("x")[1].alias("hi"), _none("string", "own_currency"), _none("string", "own_interval"), _none("double", "own_scale"),
        "source", "instance", "category", "workplace", F.lit("true").alias("equity"),
    )
    return pay.unionByName(equity.dropDuplicates())


def posting_quantities(ashby: DataFrame) -> DataFrame:
    """Pay, weight, distance and experience in the prose of ashby_jobs; of one quantity the first."""
    base = ashby.where("description_plain IS NOT NULL").select(
        F.lit("ashby_jobs").alias("tbl"), "row_id", F.lit("ashby").alias("source"), _none("string", "instance"), F.col("employment_type").alias("category"), F.col("workplace_type").alias("workplace"), "description_plain"
    )
    said = _text_amounts(base, "description_plain", cues=True, physical=True).drop("description_plain")
    of = lambda q: F.filter("said", lambda x: x["quantity"] == q)
    stated = F.filter("said", lambda x: (x["quantity"] == "pay") & x["interval"].isNotNull())
    # An amount with its interval goes before one without.
    pay = F.coalesce(F.get(stated, F.lit(0)), F.get(of("pay"), F.lit(0)))
    each = F.array(pay, *[F.get(of(q), F.lit(0)) for q in ("weight", "distance", "experience")])
    rows = said.select("tbl", "row_id", "source", "instance", "category", "workplace", F.explode(each).alias("x")).where("x IS NOT NULL")
    return rows.select(
        "tbl", "row_id", "x.quantity", "x.currency", "x.interval", F.lit(1.0).alias("scale"), "x.lo", "x.hi", _none("string", "own_currency"), _none("string", "own_interval"), _none("double", "own_scale"),
        "source", "instance", "category", "workplace", F.lit("false").alias("equity"),
    )


def per_year_of(interval: Column) -> Column:
    """How often an interval fits into a year."""
    return F.create_map(*[F.lit(x) for k, v in PER_YEAR.items() for x in (k, float(v))])[interval]


def _features(df: DataFrame, target: str, codes: dict[str, list]) -> DataFrame:
    """Magnitude, as written and of a year, spread, roundness and the neighbouring fields' values, one place each, as one vector."""
    from pyspark.ml.functions import array_to_vector

    lo, hi = F.abs(F.coalesce("lo", F.lit(0.0))), F.abs(F.coalesce("hi", F.lit(0.0)))
    size = F.log10(F.greatest(lo, F.lit(1e-6)))
    parts = [size, F.least(hi / F.greatest(lo, F.lit(1e-6)), F.lit(10.0)), (F.pmod(lo, F.lit(1.0)) > 0).cast("double"), (F.pmod(lo, F.lit(100.0)) > 0).cast("double"), F.pmod(size, F.lit(1.0))]
    if target != "interval":
        parts.append(size + F.log10(per_year_of(F.col("interval"))))
    if target != "scale":
        parts.append(size + F.log10(F.coalesce("scale", F.lit(1.0))))
    parts += [F.coalesce((F.col(c) == F.lit(v)).cast("double"), F.lit(0.0)) for c, vs in codes.items() for v in vs]
    return df.withColumn("features", array_to_vector(F.array(*[F.coalesce(p, F.lit(0.0)) for p in parts])))


def monotone(p: np.ndarray, right: np.ndarray) -> tuple[list[float], list[float]]:
    """Isotonic fit by pooling adjacent violators: (from, rate) of the steps, from the least probability up.

    Each pool's rate is drawn a little to one half, by one row in all, so that a
    small pool never is certain; pools that this puts out of order are joined.
    """
    order = np.argsort(p, kind="stable")
    pools: list[list[float]] = []  # [from, rows, right]
    rate = lambda x: (x[2] + 0.5) / (x[1] + 1)
    xs, ys = p[order], right[order].astype(float)
    for x, y in zip(xs.tolist(), ys.tolist(), strict=True):
        if pools and pools[-1][0] == x:
            pools[-1][1] += 1
            pools[-1][2] += y
        else:
            pools.append([x, 1.0, y])
        while len(pools) > 1 and rate(pools[-2]) >= rate(pools[-1]):
            _, n, k = pools.pop()
            pools[-1][1] += n
            pools[-1][2] += k
    return [x[0] for x in pools], [rate(x) for x in pools]


def fit_unit(rows: DataFrame, target: str, sample: int = SAMPLE_ROWS, trees: int = 12):
    """A calibrated random forest for one missing unit, or null without two classes.

    At most ``sample`` rows that state the unit train it: two thirds grow the
    trees, one third calibrates each class by an isotonic fit of how often it
    was right at a probability. Returns (model, classes, steps of each class,
    codes, share of all labelled rows that were taken).
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import vector_to_array

    stated = rows.where((F.col("quantity") == "pay") & F.col(target).isNotNull())
    n = stated.count()
    if not n:
        return None
    share = min(1.0, sample / n)
    taken = cut(stated.where(_chance() < share).withColumn("third", F.pmod(F.xxhash64("row_id", F.lit(3)), F.lit(3))).coalesce(4))
    others = [c for c in TARGETS if c != target] + CONTEXT
    seen = taken.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in [target, *others]])).alias("x")).groupBy("x.c", "x.v").count().where("v IS NOT NULL")
    top: dict[str, list] = {}
    for r in seen.orderBy(F.desc("count"), "v").collect():  # as many values as a bounded sample has
        top.setdefault(r.c, []).append(r.v)
    cast = (lambda v: float(v)) if target == "scale" else str
    classes = sorted(cast(v) for v in top.get(target, []))
    if len(classes) < 2:
        return None
    codes = {c: [float(v) if c == "scale" else v for v in top.get(c, [])[:MOST_CODES]] for c in others}
    index = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(target)).cast("double") - 1
    ready = _features(taken.withColumn("y", index), target, codes)
    forest = RandomForestClassifier(labelCol="y", featuresCol="features", numTrees=trees, maxDepth=8, maxBins=256, minInstancesPerNode=3, featureSubsetStrategy="0.6", seed=7)
    model = forest.fit(ready.where("third <> 0"))
    judged = model.transform(ready.where("third = 0")).select(vector_to_array("probability").alias("p"), F.col("y").cast("int").alias("y")).collect()  # a third of a bounded sample
    if not judged:
        return None
    p, y = np.array([r.p for r in judged]), np.array([r.y for r in judged])
    return model, classes, [monotone(p[:, k], y == k) for k in range(p.shape[1])], codes, share


def _chance() -> Column:
    """A number in [0, 1) of each row, by which the sample is taken."""
    return F.pmod(F.xxhash64("tbl", "row_id"), F.lit(1_000_003)) / F.lit(1_000_003)


def predicted(rows: DataFrame, target: str, fitted) -> DataFrame:
    """Add ``guess`` and ``p``: the likeliest unit and its calibrated probability; nulls without a model."""
    from pyspark.ml.functions import vector_to_array

    if fitted is None:
        return rows.withColumns({"guess": F.lit(None).cast(dict(rows.dtypes)[target]), "p": F.lit(None).cast("double")})
    model, classes, steps, codes, _ = fitted
    scored = model.transform(_features(rows, target, codes)).withColumn("raw", vector_to_array("probability"))

    def rate(k: int) -> Column:
        start, value = steps[k]
        x = F.get("raw", F.lit(k))
        reached = F.size(F.filter(F.array(*[F.lit(v) for v in start]), lambda s: s <= x))
        return F.get(F.array(*[F.lit(v) for v in value]), F.greatest(reached - 1, F.lit(0)))

    rates = F.array(*[rate(k) for k in range(min(len(classes), len(steps)))])
    scored = scored.withColumn("rates", rates)
    total = F.aggregate("rates", F.lit(0.0), lambda a, x: a + x)
    best = F.array_position("rates", F.array_max("rates")).cast("int") - 1
    return scored.withColumns({"guess": F.get(F.array(*[F.lit(c) for c in classes]), best), "p": F.array_max("rates") / total}).select(*rows.columns, "guess", "p")


def _own_missing(target: str) -> Column:
    """Rows of pay whose own field, or for prose the wording, lacks the unit; a scale that no label, summary or wording tells."""
    lacks = F.col(target).isNull() if target == "scale" else F.col(target).isNull() | ((F.col("tbl") == "job_records") & F.col(f"own_{target}").isNull())
    return (F.col("quantity") == "pay") & lacks


def _with_predictions(rows: DataFrame) -> DataFrame:
    """Add guess_<target> and p_<target>, null where the record's own field has the unit; no model is fitted for what no row lacks."""
    lacking = rows.agg(*[F.count_if(_own_missing(t)).alias(t) for t in TARGETS]).first()
    if not any(lacking):
        return rows.withColumns({f"{k}_{t}": F.lit(None).cast(dict(rows.dtypes)[t] if k == "guess" else "double") for t in TARGETS for k in ("guess", "p")})
    some = _own_missing(TARGETS[0]) | _own_missing(TARGETS[1]) | _own_missing(TARGETS[2])
    out = rows.where(some)

    def fitted(t: str):
        # Amounts are written whole unless said otherwise, so those of unstated scale are examples of it, if unsure ones.
        known = rows.withColumn("scale", F.coalesce("scale", F.lit(1.0))) if t == "scale" else rows.where(F.col(f"own_{t}").isNotNull())
        return fit_unit(known, t) if lacking[t] else None

    # Each fit is a row of short jobs on a small sample; they share the cores.
    with ThreadPoolExecutor(len(TARGETS)) as pool:
        models = dict(zip(TARGETS, pool.map(fitted, TARGETS), strict=True))
    for t in TARGETS:
        out = predicted(out, t, models[t])
        for k in ("guess", "p"):
            out = out.withColumn(f"{k}_{t}", F.when(_own_missing(t), F.col(k)))
        out = out.drop("guess", "p")
    # Written once: what follows filters by the predictions, and would score the few rows that lack a unit again.
    return cut(out).unionByName(rows.where(~some), allowMissingColumns=True)


def quantities(records: DataFrame, ashby: DataFrame) -> DataFrame:
    """(tbl, row_id, quantity, unit, lo, hi, confidence, review, doubt) in common units.

    Pay in hundredths of its currency a year, equity in ppm, weight in g,
    distance in m, experience in months, rounded half up. ``confidence`` is 1
    where the record states all units; ``review`` marks predictions that are not
    confident. An amount whose scale nothing states stands as it is written
    unless another scale is certain; ``doubt`` marks those of which another one
    is likelier, but not certain. Rows without an amount, and null, empty or
    other texts, give none.
    """
    rows = _with_predictions(cut(record_quantities(records).unionByName(posting_quantities(ashby))))
    other = F.col("scale").isNull() & F.col("guess_scale").isNotNull() & (F.col("guess_scale") != 1.0)
    certain = F.col("p_scale") >= CONFIDENT
    sure = F.when(F.col("interval").isNull(), F.coalesce("p_interval", F.lit(0.0))).otherwise(1.0) * F.when(F.col("currency").isNull(), F.coalesce("p_currency", F.lit(0.0))).otherwise(1.0)
    sure = sure * F.when(other, F.when(certain, F.col("p_scale")).otherwise(1 - F.col("p_scale"))).otherwise(1.0)
    pay = F.col("quantity") == "pay"
    rows = rows.withColumns({
        "doubt": F.coalesce(other & ~certain, F.lit(False)), "units": (F.col("interval").isNull() & (F.coalesce("p_interval", F.lit(0.0)) < CONFIDENT)) | (F.col("currency").isNull() & (F.coalesce("p_currency", F.lit(0.0)) < CONFIDENT)),
        "confidence": F.when(pay, sure).otherwise(1.0), "interval": F.coalesce("interval", "guess_interval"), "currency": F.coalesce("currency", "guess_currency"),
        "scale": F.coalesce("scale", F.when(certain, F.col("guess_scale")), F.lit(1.0)),
    })
    factor = F.when(pay, per_year_of(F.col("interval")) * 100 * F.col("scale")).otherwise(F.col("scale"))
    unit = F.when(pay, F.col("currency")).otherwise(F.create_map(*[F.lit(x) for x in ("equity", "ppm", "weight", "g", "distance", "m", "experience", "month")])[F.col("quantity")])
    # Amounts are decimal: nine places before rounding remove what binary fractions add.
    whole = lambda c: F.round(F.round(F.col(c) * factor, 4)).cast("long")
    review = (pay & F.col("units")) | unit.isNull() | factor.isNull()
    return rows.select("tbl", "row_id", "quantity", unit.alias("unit"), F.least(whole("lo"), whole("hi")).alias("lo"), F.greatest(whole("lo"), whole("hi")).alias("hi"), "confidence", review.alias("review"), "doubt")


def unit_predictions(records: DataFrame, ashby: DataFrame) -> DataFrame:
    """(tbl, row_id, target, predicted, probability, stated): what was predicted where the own field lacks a unit.

    ``stated`` is what a label, the summary or the wording says, null where
    nothing does: the rows that have it measure the classifier, which never
    learned from them (of a scale, only rows that nothing states are predicted).
    """
    rows = _with_predictions(cut(record_quantities(records).unionByName(posting_quantities(ashby))))
    each = F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"guess_{t}").cast("string").alias("predicted"), F.col(f"p_{t}").alias("probability"), F.col(t).cast("string").alias("stated")) for t in TARGETS])
    return rows.select("tbl", "row_id", F.explode(each).alias("x")).select("tbl", "row_id", "x.*").where("predicted IS NOT NULL")


def found(spark: SparkSession, d: str) -> DataFrame:
    """p3_found: the quantities that are stated or confidently predicted."""
    all_rows = quantities(table(spark, d, "job_records"), table(spark, d, "ashby_jobs"))
    return all_rows.where("NOT review").select("tbl", "row_id", "quantity", "unit", "lo", "hi")


def review(spark: SparkSession, d: str) -> DataFrame:
    """p3_review: the quantities whose unit, or scale, is not certain."""
    return quantities(table(spark, d, "job_records"), table(spark, d, "ashby_jobs")).where("review OR doubt")


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """p3_predictions: the units predicted, with what the wording states where it does."""
    return unit_predictions(table(spark, d, "job_records"), table(spark, d, "ashby_jobs"))
