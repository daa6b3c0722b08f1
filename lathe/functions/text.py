"""Scalar functions on text as column expressions; each keeps null as null."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lathe.functions.places import fold

SPACES = r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(_c(c), F.lit(""))


def clean_line(c: Column | str) -> Column:
    """Runs of white space become one blank; a blank text becomes null."""
    return blank_to_null(F.trim(F.regexp_replace(_c(c), SPACES, " ")))


def clean_block(c: Column | str) -> Column:
    """Unix line ends, no blanks at line ends, none around the text; blank becomes null."""
    unix = F.regexp_replace(_c(c), r"\r\n?", "\n")
    lines = F.regexp_replace(unix, r"[^\S\n]+(?=\n|$)", "")
    return blank_to_null(F.regexp_replace(lines, r"^\s+|\s+$", ""))


def search_key(c: Column | str) -> Column:
    """Lower-case words of letters and digits, single blanks between; may be empty."""
    return F.trim(F.regexp_replace(F.lower(_c(c)), r"[^\p{IsAlphabetic}\p{N}]+", " "))


def search_document(*parts: Column | str) -> Column:
    """One searchable text of several fields: each word has a blank before it."""
    words = F.array_join(F.filter(F.array(*[search_key(p) for p in parts]), lambda x: x.isNotNull() & (x != "")), " ")
    return F.concat(F.lit(" "), words, F.lit(" "))


def has_terms(document: Column | str, query: str) -> Column:
    """Whether every term of a query starts a word of a search document; no terms hold for all."""
    out = F.lit(True)
    for term in query.split():
        out = out & F.contains(_c(document), F.concat(F.lit(" "), search_key(F.lit(term))))
    return out


def contains_word(c: Column | str, word: str) -> Column:
    import re

    return _c(c).rlike(rf"(?iU)(?<!\w){re.escape(word)}(?!\w)")


def squash(c: Column | str) -> Column:
    """Letters and digits only, in lower case, for comparing slugs."""
    return F.regexp_replace(F.lower(_c(c)), r"[^\p{IsAlphabetic}\p{N}]", "")


def titles_compatible(a: Column | str, b: Column | str) -> Column:
    """Equal search keys, or one a run of whole words of the other; empty ones never."""
    x, y = search_key(a), search_key(b)
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return (x != "") & (y != "") & (F.contains(pad(x), pad(y)) | F.contains(pad(y), pad(x)))


def word_similarity(a: Column | str, b: Column | str) -> Column:
    """Jaccard similarity of the words of two texts' search keys; 0 where both have none."""
    words = lambda c: F.filter(F.split(search_key(c), " "), lambda w: w != "")
    both, either = F.size(F.array_intersect(words(a), words(b))), F.size(F.array_union(words(a), words(b)))
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def quoted_in(text: Column | str, quote: Column | str) -> Column:
    """Whether a quote occurs in a text, words compared by their search keys."""
    pad = lambda c: F.concat(F.lit(" "), search_key(c), F.lit(" "))
    return (search_key(quote) != "") & F.contains(pad(text), pad(quote))


def clip(c: Column | str, most: int) -> Column:
    """At most ``most`` characters: cut at a blank past the half if there is one, with an ellipsis."""
    c = _c(c)
    head = F.substring(c, 1, most - 1)
    half = most // 2
    at_word = F.regexp_extract(head, rf"(?s)^(.{{{half},}})\s\S*$", 1)
    cut = F.when(at_word != "", at_word).otherwise(head)
    return F.when(F.char_length(c) <= most, c).otherwise(F.concat(F.rtrim(cut), F.lit("…")))


def summarize(c: Column | str, most: int) -> Column:
    """The longest run of whole sentences within ``most`` characters, else a clipped text."""
    c = _c(c)
    sentences = F.regexp_extract(F.substring(c, 1, most), r"(?s)^(.*[.!?])(?:\s|$)", 1)
    return F.when(F.char_length(c) <= most, c).when(sentences != "", sentences).otherwise(clip(c, most))


def html_escape(c: Column | str) -> Column:
    out = _c(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def like_escape(c: Column | str) -> Column:
    """A text as a LIKE pattern that means just itself, with backslashes as escapes."""
    out = _c(c)
    for sign in ("\\", "%", "_"):
        out = F.replace(out, F.lit(sign), F.lit("\\" + sign))
    return out


def grouped_number(c: Column | str) -> Column:
    """Whole amounts with commas between thousands, others with two decimals."""
    c = _c(c)
    return F.when(c == F.floor(c), F.format_number(c, 0)).otherwise(F.format_number(c, 2))


def age_text(seconds: Column | str) -> Column:
    """Age in the largest whole unit: just now, minutes, hours, days, months, years ago."""
    s = _c(seconds)
    out = F.lit(None).cast("string")
    for least, unit, word in ((31_536_000, 31_536_000, "year"), (2_592_000, 2_592_000, "month"), (86_400, 86_400, "day"), (3600, 3600, "hour"), (60, 60, "minute")):
        n = F.floor(s / unit).cast("long")
        out = F.when(out.isNull() & (s >= least), F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))).otherwise(out)
    return F.when(s.isNull(), None).otherwise(F.coalesce(out, F.lit("just now")))


def changed_fields(pairs: dict[str, tuple[Column, Column]]) -> Column:
    """Names of the fields whose two values differ, null a value of its own, in the order given."""
    return F.array_compact(F.array(*[F.when(~a.eqNullSafe(b), F.lit(n)) for n, (a, b) in pairs.items()]))


def fold_key(c: Column | str) -> Column:
    """Search key without accents; Spark has no Unicode decomposition, so an Arrow function."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else fold(x))

    return search_key(run(_c(c)))


def words_with_offsets(c: Column | str) -> Column:
    """array<struct<word,start,end>>: words with the signs of technologies (c++, c#, .net, node.js), offsets in code points."""
    @F.pandas_udf("array<struct<word:string,start:int,end:int>>")
    def run(s: pd.Series) -> pd.Series:
        import regex

        find = regex.compile(r"(?:(?<!\w)\.)?[\p{L}\p{N}]+(?:[.'’\-/&][\p{L}\p{N}]+)*(?:\+\+|#|\+)?").finditer
        return s.map(lambda t: None if t is None else [{"word": m[0], "start": m.start(), "end": m.end()} for m in find(t)])

    return run(_c(c))


def sentence_list(c: Column | str) -> Column:
    """Sentences of a text: line breaks and bullets end one, abbreviations and decimals do not."""
    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        import regex

        short = r"(?<!\b(?:e\.g|i\.e|etc|vs|mr|mrs|ms|dr|st|inc|ltd|co|approx|no|p\.a|u\.s|u\.k)\.)"
        split = regex.compile(rf"(?:[\r\n]+\s*(?:[-•*·–]\s+)?)|(?<=[.!?…]['\"”’)]*){short}\s+(?=[\p{{Lu}}\p{{N}}\"“'(])", regex.IGNORECASE).split
        return s.map(lambda t: None if t is None else [x.strip(" \t•*·") for x in split(t) if x and x.strip(" \t•*·-")])

    return run(_c(c))
