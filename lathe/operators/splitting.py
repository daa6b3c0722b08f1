"""Several values packed in one field, split by the cheapest dialect.

A dialect is a set of delimiters, with or without quoting. Each parse of a
field by a dialect has a description length: the bits of its values, by how
often the whole corpus has them or by how they are composed, and the bits of
its delimiters. The corpus counts are one distributed aggregation, the lengths
one join, and every field is parsed with the dialect that describes it in the
fewest bits. Work is done once for a distinct field.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, combinations
from math import log2

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.functions.places import ARRANGEMENT, AROUND, Gazetteer, gazetteer, token, tokens
from lathe.operators.joins import skewed
from lathe.session import cut, growing, spread, table

# Delimiters by kind, in the order in which they are tried at a place.
DELIMITERS = {
    "lines": r"[\r\n\u2028\u2029\x0b]+(?:\s*[-*]\s+)?",
    "semicolon": r";",
    "pipe": r"\|+",
    "bullet": r"[•‣▪●]",
    "dot": r"[·∙]",
    "slash": r"/+",
    "plus": r"\s\+\s",
    "and": r"(?:,\s*)?(?<=\s)(?:and|und|y|et)(?=\s)",
    "or": r"(?:,\s*)?(?<=\s)or(?=\s)",
    "ampersand": r"&",
    "comma": r",",
}
#: Bits of a sign that nothing explains, of a joint within a value, of a delimiter left inside one, of declaring a delimiter, and of one use of it.
SIGN_BITS, JOINT_BITS, ODD_BITS, DECLARE_BITS, DELIMITER_BITS = 5.0, 1.0, 8.0, 2.0, 1.0
#: Characters of values that one batch of parses holds before it is handed on.
BATCH_CHARS = 4_000_000
_ANY = re.compile("|".join(f"(?P<{k}>{p})" for k, p in DELIMITERS.items()), re.IGNORECASE)
_WORD = re.compile(r"[^\W_]+")
#: Bits that choose a letter and its slip, and one of the words around names; a name costs the choice among all listed ones.
SLIP_BITS, WORD_BITS = log2(26) + 1, log2(len(ARRANGEMENT | AROUND))
_BLANK = " \t\r\n\u00a0\u2007\u2009\u202f\u200b\ufeff"
_CLOSED, _APART = re.compile(r"\([^()]*\)|\b[nN]/[aA]\b"), re.compile(r"[;|•·,()\r\n\"]|\s[-–—]\s|(?<!\w)or(?!\w)", re.IGNORECASE)
_JOINTS, _SIGNS = re.compile(r"[,()]|[-–—]"), re.compile(r"[\s,()\-–—]")
_BLANKS, _OPEN, _QUOTED = re.compile(f"[{_BLANK}]*"), re.compile(f'[{_BLANK}]*"'), re.compile(r'"((?:[^"]|"")*+)"(?!")')


class Parser:
    """Parses of single fields, given the listed names that are never split."""

    def __init__(self, names: Gazetteer):
        self.g = names
        # What repeats within a field's dialects and over a task's fields is worked out once.
        self.element = lru_cache(maxsize=50_000)(self._element)
        self.composed_bits = lru_cache(maxsize=50_000)(self._composed_bits)
        self.protected = lru_cache(maxsize=5_000)(self._protected)
        self.places = lru_cache(maxsize=5_000)(self._places)
        self.hits = lru_cache(maxsize=50_000)(self._hits)
        self.name_bits = log2(1 + len(names.names))

    def _element(self, text: str) -> str:
        """What an element after a comma is: place, part (region or country), arrangement, blank or other."""
        toks, hits = self.hits(text.strip(_BLANK))
        if not toks:
            return "blank"
        if self.g.is_placeholder(text) or all(t in ARRANGEMENT or t in AROUND or t.isdigit() for t in toks):
            return "arrangement"
        kinds = [{e.kind for e in hit[2]} for hit in hits]
        if not kinds:
            return "other"
        return "part" if not any("place" in k and not k & {"country", "region"} for k in kinds) and "place" not in kinds[0] else "place"

    def _protected(self, text: str) -> list[tuple[int, int]]:
        """Spans inside which no delimiter counts: brackets, placeholders, listed names."""
        spans = [m.span() for m in _CLOSED.finditer(text)]
        kept = [(m.start(), m.end(), t) for m in _WORD.finditer(text) if (t := token(m[0])) is not None]
        if not kept:
            return spans
        toks = [t for _, _, t in kept]
        near = [self.g.repair(t) for t in toks]
        # A name may hold a slash, a hyphen, an ampersand or a connecting word, but no stronger delimiter.
        segment, k = [], 0
        for i, (s, _, _) in enumerate(kept):
            between = text[kept[i - 1][1] : s] if i else ""
            if i and between != " " and _APART.search(between):
                k += 1
            segment.append(k)
        for a, b, _, _ in self.g.occurrences(toks, near, segment):
            if b - a > 1:
                spans.append((kept[a][0], kept[b - 1][1]))
        return spans

    def _places(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, from, to) of the delimiters outside protected spans, in order."""
        found = [(m.lastgroup, *m.span()) for m in _ANY.finditer(text)]
        if not found or ("(" not in text and all(k == "comma" for k, _, _ in found)):
            return found  # only brackets ever hold a comma
        spans, out, i = sorted(self.protected(text)), [], 0
        ends = list(accumulate((b for _, b in spans), max))
        for kind, a, b in found:  # spans that start before, the furthest end of which tells
            while i < len(spans) and spans[i][0] <= a:
                i += 1
            if not i or ends[i - 1] <= a:
                out.append((kind, a, b))
        return out

    def _hits(self, text: str) -> tuple[list[str], list]:
        """Tokens of a text and the listed names among them."""
        toks = tokens(text)
        return toks, self.g.occurrences(toks, [self.g.repair(t) for t in toks], [0] * len(toks))

    def dialects(self, text: str) -> Iterator[tuple[tuple[str, ...], bool]]:
        """Every set of the kinds of delimiters that occur, each with and without quoting if there are quotes."""
        if self.g.is_placeholder(text):
            yield (), False
            return
        kinds = list(dict.fromkeys(k for k, _, _ in self.places(text)))
        for n in range(len(kinds) + 1):
            for c in combinations(kinds, n):
                yield c, False
                if '"' in text:
                    yield c, True

    def parse(self, text: str, kinds: tuple[str, ...], quoted: bool) -> list[str] | None:
        """Values by one dialect, or null if its quotes do not fit."""
        pieces = self._quoted(text, kinds) if quoted else self._plain(text, kinds)
        return None if pieces is None else self._joined(pieces)

    def _plain(self, text: str, kinds: tuple[str, ...]) -> list[tuple[str, bool, str]]:
        """(text, was quoted, delimiter before it) of the pieces between the delimiters of a dialect."""
        pieces, start, before = [], 0, ""
        for kind, a, b in self.places(text):
            if kind in kinds:
                pieces.append((text[start:a], False, before))
                start, before = b, kind
        return [*pieces, (text[start:], False, before)]

    def _quoted(self, text: str, kinds: tuple[str, ...]) -> list[tuple[str, bool, str]] | None:
        """As ``_plain``; a piece that starts with a quote ends at the closing one, which a delimiter must follow."""
        spans, pieces, at, before = self.protected(text), [], 0, ""
        while True:
            m = _OPEN.match(text, at)
            if m:
                whole = _QUOTED.match(text, m.end() - 1)
                if not whole:
                    return None
                pieces.append((whole[1].replace('""', '"'), True, before))
                nxt = _BLANKS.match(text, whole.end()).end()
                if nxt == len(text):
                    return pieces
                sep = _ANY.match(text, nxt)
                if sep is None or sep.lastgroup not in kinds:
                    return None
            else:
                sep = next((x for x in _ANY.finditer(text, at) if x.lastgroup in kinds and not any(a <= x.start() < b for a, b in spans)), None)
                pieces.append((text[at : sep.start() if sep else len(text)], False, before))
                if sep is None:
                    return pieces
            at, before = sep.end(), sep.lastgroup

    def _joined(self, pieces: list[tuple[str, bool, str]]) -> list[str]:
        """Values of the pieces: after an unquoted comma only a further place starts a new one."""
        if all(delimiter != "comma" for _, _, delimiter in pieces):  # nothing can belong to the value before it
            return [v for v in (p if q else p.strip(_BLANK) for p, q, _ in pieces) if v.strip(_BLANK)]
        out: list[tuple[str, bool]] = []
        end_of_last = "blank"
        for piece, was_quoted, delimiter in pieces:
            if not piece.strip(_BLANK) and not was_quoted:
                if delimiter and delimiter != "comma":
                    end_of_last = "blank"
                continue
            kind = self.element(piece)
            if delimiter == "comma" and not was_quoted and out and not out[-1][1] and end_of_last != "blank":
                if kind in ("part", "arrangement", "blank") or (kind == "place" and end_of_last == "arrangement"):
                    out[-1] = (out[-1][0] + "," + piece, False)
                    end_of_last = kind if kind == "place" else end_of_last if end_of_last != "arrangement" else "arrangement" if kind == "arrangement" else "place"
                    continue
            out.append((piece, was_quoted))
            end_of_last = kind
        return [v for v in (p if q else p.strip(_BLANK) for p, q in out) if v.strip(_BLANK)]

    def _composed_bits(self, value: str) -> float:
        """Bits of a value by its composition: names from the lists, known words, and signs that nothing explains."""
        toks, hits = self.hits(value)
        bits, covered, places = 0.0, 0, 0
        for a, b, entries, d in hits:
            bits += self.name_bits + SLIP_BITS * d
            places += all(e.kind == "place" for e in entries)
            covered += sum(map(len, toks[a:b]))
        for t in toks:
            if t in ARRANGEMENT or t in AROUND:
                bits += WORD_BITS
                covered += len(t)
        # Signs that join a place to its parts are expected in a value, delimiters of any dialect are not.
        inner = [m for m in _ANY.finditer(value) if m.lastgroup != "comma"]
        spans = self.protected(value) if inner else []
        odd = sum(len(m[0].strip()) or 1 for m in inner if not any(a <= m.start() < b for a, b in spans))
        joints = len(_JOINTS.findall(value))
        plain = len(_SIGNS.sub("", value)) - covered
        odd += max(places - 1, 0)  # a second place is as odd as a delimiter
        return bits + JOINT_BITS * joints + SIGN_BITS * max(plain, 0) + ODD_BITS * odd


def _candidates(fields: DataFrame, names) -> DataFrame:
    """(field, dialect, signs, overhead, vals, bits): every dialect's parse of each distinct field."""

    columns = ["field", "dialect", "signs", "overhead", "vals", "bits"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = Parser(names.value)
        rows: list[list] = []
        held = 0
        for b in batches:
            for text in b["field"]:
                seen: dict[tuple, list] = {}
                for kinds, quoted in p.dialects(text):
                    values = p.parse(text, kinds, quoted)
                    if not values:
                        continue
                    key = tuple(values)
                    if key in seen:  # the same parse by a larger dialect
                        seen[key][2] = len(kinds) + quoted
                        continue
                    over = DECLARE_BITS * (len(kinds) + quoted) + DELIMITER_BITS * (len(values) - 1)
                    seen[key] = [text, "+".join(kinds) + ("+quotes" if quoted else ""), len(kinds) + quoted, over, values, None]
                    held += 2 * len(text)
                for row in seen.values():  # a field that all dialects read alike has nothing to weigh
                    row[5] = [p.composed_bits(v) if len(seen) > 1 else 0.0 for v in row[4]]
                rows += seen.values()
                if held > BATCH_CHARS:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=columns)
                rows, held = [], 0

    return fields.mapInPandas(run, "field string, dialect string, signs int, overhead double, vals array<string>, bits array<double>")


def split_values(df: DataFrame, key: str, field: str, places: DataFrame, countries: DataFrame) -> DataFrame:
    """(key, pos, val, n): every value of a field in order of writing, and the field's number of values.

    Null and blank fields have no rows; a field of one value has one row. The
    values are without delimiters, surrounding quotes and blanks, doubled
    quotes single, else as written. Of parses with equal bits the one with more
    values wins, then the dialect by name. Repeated keys keep all their rows.
    """
    spark = df.sparkSession
    names = spark.sparkContext.broadcast(gazetteer(places, countries))  # bounded by gazetteer()
    rows = df.select(F.col(key).alias("__key"), F.col(field).alias("field")).where(F.trim(F.regexp_replace("field", r"[\s\u00a0\u200b\ufeff]+", " ")) != "")
    # Counting distinct fields first keeps a field with a third of all rows one row from here on.
    fields = cut(rows.groupBy("field").agg(F.count(F.lit(1)).alias("rows")))
    # The parses are the work: the few bytes of the distinct fields are spread over all cores first.
    parsed = cut(_candidates(spread(fields.select("field"), "field"), names))
    each = parsed.select("field", "dialect", "overhead", F.size("vals").alias("n"), F.posexplode(F.arrays_zip("vals", "bits")).alias("i", "v"))
    each = each.withColumn("code", F.lower(F.trim("v.vals")))
    # How often the corpus has a value: in the parse by all delimiters, which names each field's parts.
    widest = parsed.groupBy("field").agg(F.max_by("vals", F.struct("signs", F.size("vals"), "dialect")).alias("vals")).join(growing(fields), "field")
    book = widest.select(F.explode("vals").alias("v"), "rows").groupBy(F.lower(F.trim("v")).alias("code")).agg(F.sum("rows").alias("seen"), F.count(F.lit(1)).alias("parses"))
    book = cut(book)
    total = book.agg(F.sum("seen")).first()[0] or 1
    # A value as frequent as "remote" is in a third of all parses, a field of it in a third of all rows.
    coded = skewed(each, book, ["code"], "parses", "left")
    # A code's entry in the book is paid once by all that use it, so a value seen once gains nothing.
    bits = F.least(F.col("v.bits"), F.coalesce(F.log2(F.lit(float(total)) / F.col("seen")) + 1 + F.col("v.bits") / F.col("seen"), F.lit(1e9)))
    cost = coded.groupBy("field", "dialect").agg((F.sum(bits) + F.first("overhead")).alias("cost"), F.first("n").alias("n"))
    best = cost.groupBy("field").agg(F.min_by("dialect", F.struct(F.round("cost", 6), -F.col("n"), "dialect")).alias("dialect"))
    chosen = parsed.join(growing(best), ["field", "dialect"]).select("field", "vals", F.size("vals").alias("n"))
    out = skewed(rows, chosen, ["field"], "rows", counts=fields).select(F.col("__key").alias(key), F.posexplode("vals").alias("i", "val"), "n")
    return out.select(key, (F.col("i") + 1).cast("long").alias("pos"), "val", "n")


def located(greenhouse: DataFrame, records: DataFrame) -> DataFrame:
    """(id, field): the packed fields of both tables, id naming table and row."""
    one = greenhouse.select(F.struct(F.lit("greenhouse_jobs").alias("tbl"), "row_id").alias("id"), F.col("location.name").alias("field"))
    return one.unionByName(records.select(F.struct(F.lit("job_records").alias("tbl"), "row_id").alias("id"), F.col("location").alias("field")))


def found(spark: SparkSession, d: str) -> DataFrame:
    """p6_found: the fields of two values and more, one row per value."""
    t = {n: table(spark, d, n) for n in ("greenhouse_jobs", "job_records", "places", "countries")}
    values = split_values(located(t["greenhouse_jobs"], t["job_records"]), "id", "field", t["places"], t["countries"])
    return values.where("n > 1").select("id.tbl", "id.row_id", "pos", "val")
