"""Quantities: wording, fields, and held-out accuracy of predicted units."""

import random

import numpy as np

from lathe.functions.quantities import amounts, measures
from lathe.operators.quantities import CONFIDENT, monotone, quantities, unit_predictions

REC = (
    "row_id long, source struct<kind:string,instance:string>, employment_type string, workplace_type string, "
    "compensation struct<summary:string,components:array<struct<kind:string,label:string,currency:string,min:double,max:double,interval:string>>>, tbl string"
)
ASH = "row_id long, employment_type string, workplace_type string, description_plain string, unit int"


def test_amounts():
    one = lambda t: amounts(t, False)
    assert one("$145k-147k per year") == [("USD", "year", 145000, 147000)]
    assert one("€9–12k p.a. • Offers Equity") == [("EUR", "year", 9000, 12000)]
    assert one("INR 1,629–1,630.50 per hour") == [("INR", "hour", 1629, 1630.5)]
    assert one("₹24.92-24.98 lakh annually") == [("INR", "year", 2492000, 2498000)]
    assert one("295'000 PLN p.a.") == [("PLN", "year", 295000, 295000)]
    assert one("€51.000 - €54.000 p.a.") == [("EUR", "year", 51000, 54000)]
    assert one("6 400 EUR/mo") == [("EUR", "month", 6400, 6400)]
    assert one("2.831K INR an hour") == [("INR", "hour", 2831, 2831)]
    assert one("annual 58k USD") == [("USD", "year", 58000, 58000)]
    assert one("239000–252000 zł/yr") == [("PLN", "year", 239000, 252000)]
    assert one("2,128,000-2,143,000 INR/yr") == [("INR", "year", 2128000, 2143000)]
    assert amounts("Revenue passed €9M, and we fit around 9 tables. We closed a $30M round.", True) == []
    assert amounts("Tickets cost $12 here.", True) == [] and amounts(None, True) == [] and amounts("", False) == []
    assert amounts("Offer: USD 57k", True) == [("USD", None, 57000, 57000)]


def test_measures():
    kg = 453.59237
    assert measures("The job includes carrying loads of up to 40lbs.") == [("weight", 40 * kg, 40 * kg)]
    assert measures("You can lift 3-stone without help.")[0][1:] == (3 * 6350.29318,) * 2
    assert measures("Crates that weigh 12,500 g.") == [("weight", 12500, 12500)]
    assert measures("Travel radius: 9000 m around the depot.") == [("distance", 9000, 9000)]
    assert measures("Please live within 35 mi of the office.") == [("distance", 35 * 1609.344,) * 1 + (35 * 1609.344,)]
    assert measures("We ask for 2–4 years in a comparable role.") == [("experience", 24, 48)]
    assert measures("At least 1.5 years of relevant experience.") == [("experience", 18, 18)]
    assert measures("Minimum tenure in the field: 26 weeks.") == [("experience", 6, 6)]
    assert measures("Three years of hands-on practice expected.") == [("experience", 36, 36)]
    assert measures("The office turned 12 years old in May, all 90 square metres of it. We closed a $30M round.") == []
    assert measures("Release 4.2. 104 weeks of hands-on practice expected.") == [("experience", 24, 24)]


def test_fields_and_prose(spark):
    pay = lambda label, cur, lo, hi, iv, kind="salary": (kind, label, cur, lo, hi, iv)
    src = ("ashby", "x")
    rows = [
        (1, src, None, None, (None, [pay("Range (cents)", "GBP", 6600000.0, None, "year")]), "t"),
        (2, src, None, None, ("€119K/yr", [pay("%", None, 0.4, 1.6, None, "equity_percentage")]), "t"),
        (3, src, None, None, (None, [pay("discretionary", None, None, None, "year", "bonus")]), "t"),
        (4, src, None, None, ("$340 – 570 p/d", [pay(None, None, 340.0, 570.0, "day")]), "t"),
        (5, src, None, None, (None, [pay("Day rate", "usd", 350.0, 550.0, None), pay("bps", None, 75.0, 75.0, None, "equity_percentage"), None]), "t"),
        (6, src, None, None, None, "t"),
        (7, src, None, None, ("", None), "t"),
        (8, None, None, None, (None, [pay("in thousands", "PLN", 245.5, float("nan"), "1 YEAR")]), "t"),
    ]
    ash = [(1, None, None, "Offer: USD 57k/yr.\nYou can lift 10 kg without help. Prior practice: 2 years.", 1), (2, None, None, None, 1), (3, None, None, "", 1), (4, None, None, "word " * 200_000, 1)]
    got = {tuple(r)[:6] for r in quantities(spark.createDataFrame(rows, REC), spark.createDataFrame(ash, ASH)).where("NOT review").collect()}
    j, a = "job_records", "ashby_jobs"
    assert got == {
        (j, 1, "pay", "GBP", 6600000, 6600000), (j, 2, "pay", "EUR", 11900000, 11900000), (j, 2, "equity", "ppm", 4000, 16000), (j, 4, "pay", "USD", 8840000, 14820000),
        (j, 5, "pay", "USD", 9100000, 14300000), (j, 5, "equity", "ppm", 7500, 7500), (j, 8, "pay", "PLN", 24550000, 24550000),
        (a, 1, "pay", "USD", 5700000, 5700000), (a, 1, "weight", "g", 10000, 10000), (a, 1, "experience", "month", 24, 24),
    }


def test_empty_tables(spark):
    assert quantities(spark.createDataFrame([], REC), spark.createDataFrame([], ASH)).count() == 0


def records(spark, n, seed, hide):
    """Pay in overlapping magnitudes; a fifth of the rows lacks the unit that ``hide`` names, and nothing else states it."""
    r, unit = random.Random(seed), {"hour": (15, 200), "day": (120, 1200), "week": (600, 5000), "month": (2000, 20000), "year": (9000, 160000)}
    rows, true = [], {}
    for i in range(n):
        k, cur = r.choice(list(unit)), r.choice(["USD", "INR", "PLN"])
        lo = round(r.uniform(*unit[k])) * {"USD": 1, "INR": 40, "PLN": 3}[cur]
        gone = i % 5 == 0
        true[i] = k if hide == "interval" else cur
        rows.append((i, ("ashby", "in" if cur == "INR" else "x"), None, None, (None, [("salary", None, None if gone and hide == "currency" else cur, float(lo), lo * 1.2, None if gone and hide == "interval" else k)]), "t"))
    return spark.createDataFrame(rows, REC), true


def test_missing_interval_is_predicted_or_reviewed(spark):
    """Hidden units of magnitudes that overlap: confident predictions are right nine times in ten, and the others are reviewed."""
    recs, true = records(spark, 3000, 3, "interval")
    none = spark.createDataFrame([], ASH)
    got = {r.row_id: r for r in unit_predictions(recs, none).where("target = 'interval'").collect()}
    assert sorted(got) == [i for i in range(3000) if i % 5 == 0] and all(r.stated is None for r in got.values())
    right = {i: r.predicted == true[i] for i, r in got.items()}
    sure = [i for i, r in got.items() if r.probability >= CONFIDENT]
    assert sum(right[i] for i in sure) / len(sure) >= 0.9 and len(sure) > 200
    # Calibration: mean probability and accuracy agree over all predictions.
    assert abs(sum(r.probability for r in got.values()) / len(got) - sum(right.values()) / len(right)) < 0.06
    out = quantities(recs, none).collect()
    assert len(out) == 3000 and {r.row_id for r in out if r.review} == set(got) - set(sure) and len(got) - len(sure) > 20
    assert all(r.confidence == 1 for r in out if r.row_id % 5)


def test_missing_currency_by_source(spark):
    recs, true = records(spark, 2000, 4, "currency")
    got = {r.row_id: r for r in unit_predictions(recs, spark.createDataFrame([], ASH)).where("target = 'currency'").collect()}
    of_source = [i for i in got if true[i] == "INR"]
    assert sum(got[i].predicted == "INR" for i in of_source) / len(of_source) > 0.97


def test_nothing_missing_fits_nothing(spark, monkeypatch):
    from lathe.operators import quantities as q

    recs = spark.createDataFrame([(i, ("ashby", "x"), None, None, ("$50k per year", [("salary", None, "USD", 50000.0, 50000.0, "year")]), "t") for i in range(20)], REC)
    monkeypatch.setattr(q, "fit_unit", lambda *a, **k: 1 / 0)
    assert q.quantities(recs, spark.createDataFrame([], ASH)).where("NOT review").count() == 20


def test_wording_overrides_a_prediction(spark):
    rows = [(i, ("ashby", "x"), None, None, (None, [("salary", None, "USD", 50000.0 + i, 60000.0, "year")]), "t") for i in range(200)]
    rows += [(200 + i, ("ashby", "x"), None, None, (None, [("salary", None, "USD", 30.0 + i, 40.0, "hour")]), "t") for i in range(200)]
    rows += [(400, ("ashby", "x"), None, None, ("$30 - $40 per day", [("salary", None, None, 30.0, 40.0, None)]), "t")]
    recs = spark.createDataFrame(rows, REC)
    none = spark.createDataFrame([], ASH)
    r = quantities(recs, none).where("row_id = 400").first()
    assert (r.unit, r.lo, r.hi, r.review) == ("USD", 30 * 260 * 100, 40 * 260 * 100, False)
    p = unit_predictions(recs, none).where("row_id = 400 AND target = 'interval'").first()
    assert (p.predicted, p.stated) == ("hour", "day")


def test_hidden_scale(spark):
    """Thousands that not all labels name: where few are unnamed some are converted, and nearly all others doubted."""
    for hidden in (60, 9):
        r = random.Random(8)
        rows = []
        for i in range(1500):
            k = i % 3 == 0
            lo = float(r.randint(40, 200) * (1 if k else 1000))
            rows.append((i, ("ashby", "x"), None, None, (None, [("salary", "in thousands" if k and i % hidden else None, "USD", lo, lo, "year")]), "t"))
        out = quantities(spark.createDataFrame(rows, REC), spark.createDataFrame([], ASH)).collect()
        gone = [x for x in out if x.row_id % 3 == 0 and x.row_id % hidden == 0]
        whole = [4_000_000 <= x.lo <= 20_000_000 for x in gone]
        assert len(out) == 1500 and not any(x.review for x in out)
        assert all(4_000_000 <= x.lo <= 20_000_000 and not x.doubt for x in out if x not in gone)
        assert sum(w or x.doubt for w, x in zip(whole, gone, strict=True)) >= 0.9 * len(gone)
        assert any(whole) == (hidden == 60)


def test_isotonic_fit():
    """Bins of uneven success come out in order, each near its own rate."""
    p = np.concatenate([np.full(n, v) for n, v in ((10, 0.1), (40, 0.3), (80, 0.5), (200, 0.7), (100, 0.9))])
    y = np.concatenate([np.arange(n) < k for n, k in ((10, 10), (40, 20), (80, 40), (200, 120), (100, 80))])
    start, rate = monotone(p, y)
    assert rate == sorted(rate) and start == [0.1, 0.7, 0.9]
    assert abs(rate[0] - 70 / 130) < 0.01 and abs(rate[1] - 0.6) < 0.01 and abs(rate[2] - 0.8) < 0.01
    assert monotone(np.array([]), np.array([])) == ([], [])
