"""Typed places: names, codes, slips, context; repair against brute force."""

import random

from lathe.functions.places import gazetteer, slips, slips_allowed
from lathe.llm.matching import located_values, mapped, repaired_tokens, vocabulary_variants

PLACES = "geo_id long, name string, region string, country_code string, population long, other_names array<string>, ref string"
COUNTRIES = "code string, c1 string, population long, other_names array<string>"
P = [
    (1, "Sosulaedaelt", "Ruprouves", "XC", 900, [], ""), (2, "Triskekos", "Predom", "XI", 700, ["TRS"], ""), (3, "Saint Feilokux", "Lalegri", "XE", 30, None, ""),
    (4, "Stulind", "Predom", "XI", 50, [], ""), (5, "Stulind", "Detilei", "XY", 500, [], ""), (6, "Postem", "Detilei", "XY", 5, ["Lemond"], ""), (7, "Tivufeitreim & Datiha", "Thoud", "XG", 1, [], ""),
    (8, "New Pralílt", "Couklox", "XH", 2, [], ""), (9, "Titheik-Ost", "Couklox", "XH", 2, [], ""), (10, "Baden-Baden", "Couklox", "XH", 2, [], ""),
]
C = [("XC", "Tutaland", 1, ["Theivras"]), ("XI", "Peifenia", 1, []), ("XE", "Ciskigrunia", 1, ["Kingdom of Ciskigrunia"]), ("XY", "Biprikilt", 1, []), ("XG", "Bipaerkia", 1, []), ("XH", "Proubeik and Perovraem", 1, None)]


def lists(spark):
    return spark.createDataFrame(P, PLACES), spark.createDataFrame(C, COUNTRIES)


def test_values(spark):
    want = {
        "Sosulaedaelt, Tutaland": "place:1", "SOSULAEDAELT": "place:1", "sosluaedaelt": "place:1", "Sosulaedaelt (hybrid)": "place:1", "12345 Sosulaedaelt": "place:1", "Greater Sosulaedaelt Area": "place:1",
        "Trskekos": "place:2", "Trsekos": "place:2", "Trkos": "none", "TRS, Peifenia": "place:2", "St. Feilokux": "place:3", "Saint Feilokux, Lalegri, XE": "place:3", "Stulind": "place:5", "Stulind, XI": "place:4",
        "Stulind Peifenia": "place:4", "Peifenia - Stulind": "place:4", "Stulind, Predom": "place:4", "Postm": "place:6", "Pstm": "none", "Lemond": "place:6", "Tivufeitreim & Datiha, XG": "place:7",
        "new-pralilt": "place:8", "New Pralílt office": "place:8", "Titheik Ost": "place:9", "Nowhere, Theivras": "country:XC", "Remote - Kingdom of Ciskigrunia": "country:XE", "xy": "country:XY",
        "Proubeik and Perovraem": "country:XH", "Tutalnd": "country:XC", "Pralilt new": "place:8", "new xx pralilt": "place:8", "Pralilt": "none", "new": "none", "xx yy Postem": "none", "Ost Titheik, XH": "place:9",
        "Baden Baden": "place:10", "Baden": "none", "Feilokux, Triskekos": "place:2", "Nowhere": "none", "Remote": "none", "TBD": "none", "-": "none", "Sosulaedaelt, Peifenia": "country:XI", '"Postem"': "place:6", "": "none",
        "word " * 20_000: "none",
    }
    df = spark.createDataFrame([(v,) for v in want] + [(None,), ("xy",)], "val string")
    got = {r.val: r.ref for r in mapped(df, *lists(spark)).collect()}
    assert got == want


def test_repair_against_brute_force(spark):
    g = gazetteer(*lists(spark))
    r = random.Random(9)
    words = sorted(w for w in g.vocabulary if slips_allowed(w))
    toks = set()
    for _ in range(150):
        w = list(r.choice(words))
        for _ in range(r.randint(1, 3)):
            i = r.randrange(len(w))
            r.choice([lambda: w.insert(i, r.choice("aeixz")), lambda: len(w) > 5 and w.pop(i), lambda: w.__setitem__(i, r.choice("aeixz")), lambda: i and w.__setitem__(slice(i - 1, i + 1), w[i - 1 : i + 1][::-1])])()
        toks.add("".join(w))
    df = spark.createDataFrame([(t,) for t in sorted(toks)], "token string")
    got = {x.token: {(n.word, n.slips) for n in x.near} for x in repaired_tokens(df, vocabulary_variants(spark, g)).collect()}
    want = {}
    for t in toks:
        near = {(w, d) for w in words if (d := slips(t, w, slips_allowed(w))) <= slips_allowed(w)}
        if near:
            least = min(d for _, d in near)
            want[t] = {x for x in near if x[1] == least}
    assert got == want


def test_all_equally_near_words(spark):
    """A token one slip from ten listed words means each of them; region and country decide."""
    names = [f"Grando{c}el" for c in "abcdfghijk"]
    places = spark.createDataFrame([(i, n, f"Region{i}", f"C{i}", i, [], "") for i, n in enumerate(names)], PLACES)
    countries = spark.createDataFrame([(f"C{i}", f"Land{'abcdefghij'[i] * 4}", 1, []) for i in range(10)], COUNTRIES)
    df = spark.createDataFrame([(f"Grandoxel, C{i}",) for i in range(10)] + [("Grandoxel",)], "val string")
    got = {r.val: r.ref for r in mapped(df, places, countries).collect()}
    assert got == {f"Grandoxel, C{i}": f"place:{i}" for i in range(10)} | {"Grandoxel": "place:9"}


def test_positions_and_empty(spark):
    G = "row_id long, location struct<name:string>, val string"
    J = "row_id long, location string, locations array<string>, pos int"
    gh = spark.createDataFrame([(1, ("Postem; Triskekos",), ""), (2, None, ""), (3, ("  ",), ""), (4, ("Remote",), "")], G)
    jr = spark.createDataFrame([(1, None, ["Postem", None, " ", "Triskekos; Postem"], 0), (2, None, None, 0), (3, None, [], 0)], J)
    got = sorted((r.tbl, r.row_id, r.pos, r.val) for r in located_values(gh, jr, *lists(spark)).collect())
    assert got == [
        ("greenhouse_jobs", 1, 1, "Postem"), ("greenhouse_jobs", 1, 2, "Triskekos"), ("greenhouse_jobs", 4, 1, "Remote"), ("job_records", 1, 1, "Postem"), ("job_records", 1, 4, "Triskekos; Postem"),
    ]
    assert mapped(spark.createDataFrame([], "val string"), *lists(spark)).count() == 0
