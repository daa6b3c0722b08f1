"""Packed fields: delimiters, quoting, listed names and placeholders."""

from lathe.functions.places import Gazetteer, slips, tokens
from lathe.operators.splitting import Parser, split_values

PLACES = "geo_id long, name string, region string, country_code string, population long, other_names array<string>, val string"
COUNTRIES = "code string, c1 string, population long, other_names array<string>"
P = [
    (1, "Tivufeitreim & Datiha", "Thoudrou", "XG", 10, [], ""), (2, "Daezuhaeboult/Bravithein", "Neigael", "XF", 10, None, ""), (3, "Postem", "Detilei", "XY", 5, ["PST"], ""),
    (4, "Triskekos", "Predom", "XI", 7, [], ""), (5, "Sosulaedaelt", "Ruprouves", "XC", 9, [], ""), (6, "Titheik-Ost", "Vrael", "XC", 9, [], ""),
]
C = [("XG", "Bipaerkia", 1, []), ("XF", "Proubeikaexia and Perovraem", 1, None), ("XY", "Biprikilt", 1, []), ("XI", "Peifenia", 1, []), ("XC", "Tutaland", 1, ["Theivras"])]


def split(spark, fields):
    df = spark.createDataFrame([(i, f, 0) for i, f in enumerate(fields)], "k long, f string, pos int")
    out = split_values(df, "k", "f", spark.createDataFrame(P, PLACES), spark.createDataFrame(C, COUNTRIES))
    got = [[] for _ in fields]
    for r in out.orderBy("k", "pos").collect():
        got[r.k].append(r.val)
        assert r.pos == len(got[r.k])
    return got


def test_values(spark):
    want = {
        "Sosulaedaelt, Tutaland": ["Sosulaedaelt, Tutaland"],
        "Tivufeitreim & Datiha / Postem": ["Tivufeitreim & Datiha", "Postem"],
        "Tivufetreim & Datiha": ["Tivufetreim & Datiha"],
        "Daezuhaeboult/Bravithein": ["Daezuhaeboult/Bravithein"],
        "Triskekos, Proubeikaexia and Perovraem": ["Triskekos, Proubeikaexia and Perovraem"],
        "Triskekos, Sosulaedaelt, Ruprouves, XC,Postem": ["Triskekos", "Sosulaedaelt, Ruprouves, XC", "Postem"],
        '"Sosulaedaelt, XC","Anywhere"': ["Sosulaedaelt, XC", "Anywhere"],
        '"""Triskekos"""; Postem': ['"Triskekos"', "Postem"],
        "• Triskekos • Postem": ["Triskekos", "Postem"],
        "Triskekos\r\nPostem (hybrid)": ["Triskekos", "Postem (hybrid)"],
        "Postem\n- Remote - Tutaland": ["Postem", "Remote - Tutaland"],
        "; Postem;; Triskekos ;": ["Postem", "Triskekos"],
        "Postem; or Triskekos": ["Postem", "Triskekos"],
        "Postem, and Triskekos": ["Postem", "Triskekos"],
        "Postem; Triskekos (HQ), and Sosulaedaelt": ["Postem", "Triskekos (HQ)", "Sosulaedaelt"],
        "Triskekos, or Postem": ["Triskekos", "Postem"],
        "Remote - Peifenia": ["Remote - Peifenia"],
        "Remote, Postem": ["Remote, Postem"],
        "Titheik-Ost | Postem": ["Titheik-Ost", "Postem"],
        "N/A": ["N/A"],
        "": [], "    ": [],
    }
    assert split(spark, [*want, None]) == [*want.values(), []]


def test_repeated_long_and_empty(spark):
    many = " | ".join(["Postem", "Triskekos"] * 2000)
    got = split(spark, ["Postem | Triskekos"] * 3 + [many])
    assert got[:3] == [["Postem", "Triskekos"]] * 3 and len(got[3]) == 4000
    df = spark.createDataFrame([], "k long, f string")
    assert split_values(df, "k", "f", spark.createDataFrame(P, PLACES), spark.createDataFrame([], COUNTRIES)).count() == 0


def test_eleven_kinds_of_delimiters(spark):
    """However many kinds a field has, the reading without a split and every other set is scored."""
    kinds = ["\n", ";", "|", "•", "·", "/", " + ", " and ", " or ", "&", ","]
    text = "Postem" + "".join(f"{k}{'Triskekos' if i % 2 else 'Postem'}" for i, k in enumerate(kinds[:-1], 1))
    g = Gazetteer([dict(zip("geo_id name region country_code population other_names".split(), p)) for p in P], [dict(zip("code c1 population other_names".split(), c)) for c in C])
    p = Parser(g)
    sets = [k for k, _ in p.dialects("a\nb;c|d•e·f/g + h and i or j&k,l")]
    assert len(sets) == 2**11 and () in sets
    assert p.parse(text, (), False) == [text]
    assert split(spark, [text])[0] == ["Postem"] + ["Triskekos", "Postem"] * 5


def test_slips():
    assert slips("sosulaedaelt", "sosluaedaelt", 2) == 1 and slips("abc", "abcd", 1) == 1 and slips("abcdef", "uvwxyz", 2) == 3
    g = Gazetteer([dict(zip("geo_id name region country_code population other_names".split(), p)) for p in P], [dict(zip("code c1 population other_names".split(), c)) for c in C])
    assert g.repair("triskeko") == [("triskekos", 1)] and g.repair("postm") == [("postem", 1)] and g.repair("pstm") == []
    assert tokens("Pört St. Łód") == ["port", "saint", "lod"]
    assert Parser(g).element("Ruprouves") == "part" and Parser(g).element("Postem") == "place" and Parser(g).element("Remote") == "arrangement"
