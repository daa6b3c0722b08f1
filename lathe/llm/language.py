"""Languages of documents and of their passages, by compression.

For each language a zstandard raw-content dictionary holds sample text. A
sentence is compressed with every dictionary, and the smallest size wins; the
margin to the second is its confidence, and a slim margin is rejected. In a
document the sentences' sizes are added up along the cheapest path on which
each change of language costs a fixed number of bytes; so rejected sentences
follow their neighbours, and passages come out in order of writing. A passage
whose margin is slim as a whole, or that no dictionary makes much shorter than
none does, as with a language that has no dictionary, is undetermined.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.session import table

# Names and codes of languages by their ISO 639-1 code.
NAMES = {
    "ar": "arabic ara", "bg": "bulgarian bul", "ca": "catalan cat", "cs": "czech ces cze", "da": "danish dan", "de": "german deu ger deutsch",
    "el": "greek ell gre", "en": "english eng", "es": "spanish spa español castilian", "et": "estonian est", "fi": "finnish fin", "fr": "french fra fre français",
    "he": "hebrew heb", "hi": "hindi hin", "hr": "croatian hrv", "hu": "hungarian hun", "id": "indonesian ind", "it": "italian ita italiano",
    "ja": "japanese jpn 日本語", "ko": "korean kor", "lt": "lithuanian lit", "lv": "latvian lav", "nl": "dutch nld dut nederlands flemish",
    "no": "norwegian nor", "pl": "polish pol polski", "pt": "portuguese por português", "ro": "romanian ron rum", "ru": "russian rus русский",
    "sk": "slovak slk slo", "sl": "slovenian slv", "sr": "serbian srp", "sv": "swedish swe", "th": "thai tha", "tr": "turkish tur",
    "uk": "ukrainian ukr", "vi": "vietnamese vie", "zh": "chinese zho chi 中文",
}

#: Rows, and bytes of their text, that fit one language's dictionary at most.
SAMPLE_ROWS = 400
SAMPLE_BYTES = 96_000
#: Labelled rows without which a language gets no dictionary.
LEAST_ROWS = 5
#: Bytes that a change of language costs along a document.
SWITCH_BYTES = 6
#: A sentence, or passage, whose best size is not this share smaller than the second is rejected.
LEAST_MARGIN = 0.03
#: A passage whose best size is not this share smaller than without a dictionary is in none of their languages.
LEAST_GAIN = 0.08
#: The language of rejected passages.
UNDETERMINED = "und"
#: Sentences whose sizes a task remembers.
REMEMBERED = 100_000


def label_code(label: Column | str) -> Column:
    """ISO 639-1 code that a label names, in any case, region or as name; else null."""
    c = F.col(label) if isinstance(label, str) else label
    first = F.regexp_extract(F.lower(F.trim(F.regexp_replace(c, r"[\s\u00a0]+", " "))), r"^([\p{L}]+)(?:[-_ ].*)?$", 1)
    known = {n: code for code, names in NAMES.items() for n in [code, *names.split()]}
    return F.create_map(*[F.lit(x) for kv in sorted(known.items()) for x in kv])[first]


#: A break with blanks on both sides stands within a line.
_STRAY = re.compile("(?<=[ \u00a0])[\r\n\u2028\u2029\x0b\x0c\x85]+(?=[ \u00a0])").sub
_LINES = re.compile("[\r\n\u2028\u2029\x0b\x0c\x85]+").split
_ENDS = re.compile("[.!?…]['\"”’»)]*(\\s+)(?=\\S)|(?<=[。！？])(?=.)").finditer
_FULL = re.compile("[.!?…。！？]['\"”’»)\\]]*$").search
_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]").findall
_WORDS = regex.compile(r"\p{L}[\p{L}\p{M}'’-]*").findall
_ASCII_WORDS = re.compile(r"[A-Za-z][A-Za-z'-]*").findall
_DIGITS, _HIDDEN = regex.compile(r"\p{N}+").sub, regex.compile(r"\p{Cf}+").sub
_INNER = regex.compile(r"\p{L}[.!?…。！？]").search
_LONG = regex.compile(r"(?<![\p{L}./:@-])\p{L}{2,}(?![./:@]\p{L})").findall
_AROUND = " \t\u00a0•·*-–—\ufeff\u200b"


def sentences(text: str) -> list[tuple[str, bool]]:
    """(sentence, full): pieces in order of writing; ``full`` ones are real sentences."""
    out = []
    for line in _LINES(_STRAY(" ", text)):
        at, pieces = 0, []
        for m in _ENDS(line):
            first, last = m.span(1) if m[1] else m.span()
            pieces.append(line[at:first])
            at = last
        for s in (*pieces, line[at:]):
            s = s.strip(_AROUND)
            if s:
                out.append((s, is_sentence(s)))
    return out


def is_sentence(s: str) -> bool:
    """Ends like a sentence and has at least four words, or eight signs of a script without blanks."""
    if not _FULL(s):
        return False
    return len(_ASCII_WORDS(s)) >= 4 if s.isascii() else len(_WORDS(s)) >= 4 or len(_UNSPACED(s)) >= 8


def plain(s: str) -> bytes:
    """What is compressed: case, digits, runs of blanks and invisible signs are evened out."""
    if not s.isascii():
        s = _HIDDEN("", unicodedata.normalize("NFKC", s))
    return _DIGITS("0", " ".join(s.lower().split())).encode("utf-8", "ignore")


class Compressors:
    """One zstandard compressor per language, each with its raw-content dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = 3):
        import zstandard as z

        self.langs = sorted(dictionaries)
        self.by = []
        for code in self.langs:
            d = z.ZstdCompressionDict(dictionaries[code], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.by.append(z.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
        self.bare = z.ZstdCompressor(level=level, write_checksum=False, write_content_size=False)
        self.known: dict[bytes, list[int]] = {}

    def sizes(self, sentence: bytes) -> list[int]:
        """Compressed sizes with each dictionary, and without one; sentences that come again are remembered."""
        out = self.known.get(sentence)
        if out is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            out = self.known[sentence] = [*[len(c.compress(sentence)) for c in self.by], len(self.bare.compress(sentence))]
        return out

    def passages(self, text: str | None) -> list[tuple[int, str, float]]:
        """(pos, lang, confidence) of the passages of one language; [] without a sentence of words.

        The language of a rejected passage is ``und``, its confidence what speaks
        for the best one.
        """
        if not text or not self.langs:
            return []
        parts = sentences(text)
        if not any(full for _, full in parts):  # a text of one sentence that breaks or odd ends hide
            whole = " ".join(text.split())
            parts = sentences(whole)
            if not any(full for _, full in parts):
                if not _INNER(whole) or len(_LONG(whole)) < 5:
                    return []
                parts = [(whole, True)]
        # Lines that are no sentences (titles, headings, single words) say nothing about a change.
        n = len(self.by)
        sizes = np.array([self.sizes(plain(s)) for s, ok in parts if ok], np.float64)
        sizes, bare = sizes[:, :n], sizes[:, n]
        best = sizes.argmin(axis=1)
        sure = np.ones(len(sizes), bool)
        if n == 1:
            path = best.tolist()
        else:
            two = np.partition(sizes, 1, axis=1)
            sure = 1 - two[:, 0] / two[:, 1] >= LEAST_MARGIN
            if not sure.any():  # all rejected: the text as a whole decides
                path = [int(sizes.sum(axis=0).argmin())] * len(sizes)
            elif len(set(best[sure].tolist())) == 1:
                path = [int(best[sure][0])] * len(sizes)
            else:
                path = self._cheapest(np.where(sure[:, None], sizes - two[:, :1], 0.0))
        out, i = [], 0
        while i < len(path):
            j = i
            while j < len(path) and path[j] == path[i]:
                j += 1
            summed = sizes[i:j].sum(axis=0)
            others = np.delete(summed, path[i])
            margin = 1 - summed[path[i]] / others.min() if len(others) else 1.0
            # Sentences with a margin speak for their passage, if it has any.
            said = slice(i, j) if not sure[i:j].any() else np.flatnonzero(sure[i:j]) + i
            gain = 1 - sizes[said].sum(axis=0)[path[i]] / bare[said].sum()
            rejected = gain < LEAST_GAIN or (margin < LEAST_MARGIN and not sure[i:j].any())
            out.append((len(out) + 1, UNDETERMINED if rejected else self.langs[path[i]], round(float(min(1.0, max(0.0, min(margin, gain) if rejected else margin))), 4)))
            i = j
        return out

    def _cheapest(self, costs: np.ndarray) -> list[int]:
        """Language of each sentence on the path of fewest bytes, changes included."""
        total, back = costs[0].copy(), []
        for c in costs[1:]:
            k = int(total.argmin())
            stay = total <= total[k] + SWITCH_BYTES
            back.append(np.where(stay, np.arange(len(total)), k))
            total = np.minimum(total, total[k] + SWITCH_BYTES) + c
        at = int(total.argmin())
        path = [at]
        for b in reversed(back):
            at = int(b[at])
            path.append(at)
        return path[::-1]


_MADE: dict[bytes, Compressors] = {}


def compressors(dictionaries: dict[str, bytes]) -> Compressors:
    """The compressors of these dictionaries; a worker makes them once for all its tasks."""
    digest = hashlib.sha256(b"\0".join(k.encode() + b"\0" + v for k, v in sorted(dictionaries.items()))).digest()
    if digest not in _MADE:
        _MADE.clear()
        _MADE[digest] = Compressors(dictionaries)
    return _MADE[digest]


def cleaned(pool: dict[str, list[bytes]], rounds: int = 4) -> dict[str, list[bytes]]:
    """Move each sample sentence to the language whose trigrams it shares most.

    Labels are right more often than wrong, so the trigrams of a language are
    most frequent under its own label. Each round counts them anew from the
    sentences as they were moved; repeated sentences vote as often as they
    occur, and none votes for itself.
    """
    langs = sorted(pool)
    texts = [(k, s) for k, c in enumerate(langs) for s in pool[c]]
    ids: dict[str, int] = {}
    rows = [[ids.setdefault(s[i : i + 3], len(ids)) for i in range(len(s) - 2)] or [ids.setdefault("", len(ids))] for s in (s.decode("utf-8", "ignore") for _, s in texts)]
    if not rows:
        return {}
    gram = np.concatenate([np.unique(r) for r in map(np.asarray, rows)])
    times = np.concatenate([np.unique(r, return_counts=True)[1] for r in map(np.asarray, rows)]).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum([len(set(r)) for r in rows])[:-1]]).astype(np.int64)
    sizes = np.add.reduceat(times, starts)
    row = np.repeat(np.arange(len(rows)), np.diff(np.append(starts, len(gram))))
    at = np.array([k for k, _ in texts])
    for _ in range(rounds):
        counts = np.zeros((len(langs), len(ids)))
        np.add.at(counts, (at[row], gram), times)
        totals = counts.sum(axis=1)
        scores = np.stack([np.add.reduceat(times * np.log(counts[k][gram] + 0.05), starts) - sizes * np.log(totals[k] + 0.05 * len(ids)) for k in range(len(langs))])
        own = counts[at[row], gram] - times
        scores[at, np.arange(len(rows))] = np.add.reduceat(times * np.log(own + 0.05), starts) - sizes * np.log(totals[at] - sizes + 0.05 * len(ids))
        scores[totals == 0] = -np.inf
        at = scores.argmax(axis=0)
    out: dict[str, list[bytes]] = {}
    for k, (_, s) in zip(at.tolist(), texts, strict=True):
        out.setdefault(langs[k], []).append(s)
    return {c: list(dict.fromkeys(p)) for c, p in out.items()}


def fit_dictionaries(documents: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> dict[str, bytes]:
    """Raw-content dictionaries from a bounded sample of labelled rows.

    Of each language that labels name, at most ``rows`` texts of 40 signs and more in
    the order of a hash, their first 4,000 signs, cut to sentences and at most ``size`` bytes. Labels may be wrong and
    texts mixed, so the sample's sentences vote by their trigrams first, and each
    goes to the language that the vote names. Languages with fewer than ``LEAST_ROWS`` rows
    get none.
    """
    labelled = documents.select(label_code("lang").alias("code"), F.substring("text", 1, 4000).alias("text"), F.xxhash64("doc_id", F.lit(7)).alias("h"))
    labelled = labelled.where("code IS NOT NULL AND length(text) >= 40")
    # The smallest hashes of each language by partial aggregation, never a sort of a whole language.
    bucket = F.pmod(F.col("h"), F.lit(64))
    counts = {r.code: r.n for r in labelled.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for code, n in sorted(counts.items()) for x in (code, min(1.0, 1.5 * rows / n))])[F.col("code")]
    near = labelled.where(F.pmod(F.col("h"), F.lit(1_000_003)) < share * 1_000_003).withColumn("b", bucket)
    taken = near.groupBy("code", "b").agg(F.sort_array(F.collect_list(F.struct("h", "text"))).alias("x")).collect()
    texts: dict[str, list[str]] = {}
    for r in sorted(taken, key=lambda r: (r.code, r.b)):
        texts.setdefault(r.code, []).extend(x.text for x in r.x)
    texts = {c: t[:rows] for c, t in texts.items() if counts[c] >= LEAST_ROWS}
    pool = {c: [plain(s) for t in ts for s, ok in sentences(t) if ok] for c, ts in texts.items()}
    pool = {c: p for c, p in pool.items() if p}

    def joined(parts: list[bytes]) -> bytes:
        out, n = [], 0
        for s in parts:
            if n + len(s) > size:
                break
            out.append(s)
            n += len(s) + 1
        return b"\n".join(out)

    pool = cleaned(pool)
    return {c: joined(p) for c, p in pool.items() if len(joined(p)) >= 8}


def detect(documents: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """(doc_id, label, passages, pos, lang, confidence): one row per passage of one language.

    ``label`` is the code that the given label names, or null, and ``passages``
    the number of the document's passages. Null, empty and
    wordless texts, and texts without one full sentence, have no rows; whole
    texts are read, equal ones once where they meet. Repeated doc_ids are treated
    row by row. Rejected passages have the language ``und``.
    """
    shared = documents.sparkSession.sparkContext.broadcast(dictionaries)  # languages times SAMPLE_BYTES at most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = compressors(shared.value) if shared.value else None
        told: dict[str, list] = {}
        for b in batches:
            rows = []
            for d, label, t in zip(b["doc_id"], b["label"], b["text"], strict=True):
                found = told.get(t)
                if found is None:
                    if len(told) >= REMEMBERED // 100:
                        told.clear()
                    found = told[t] = c.passages(t) if c else []
                rows += [(d, label, len(found), *p) for p in found]
            yield pd.DataFrame(rows, columns=["doc_id", "label", "passages", "pos", "lang", "confidence"]).astype({"doc_id": "int64", "passages": "int64", "pos": "int64", "confidence": "float64"})

    kept = documents.select("doc_id", label_code("lang").alias("label"), "text").where("text IS NOT NULL AND doc_id IS NOT NULL")
    return kept.mapInPandas(run, "doc_id long, label string, passages long, pos long, lang string, confidence double")


def languages(documents: DataFrame) -> DataFrame:
    """(doc_id, pos, lang, confidence) of every document with a sentence of words."""
    return detect(documents, fit_dictionaries(documents)).drop("label", "passages")


def wrong_labels(documents: DataFrame) -> DataFrame:
    """(doc_id, pos, lang) of the documents whose label is missing or wrong, or whose text mixes languages; undetermined passages are left out."""
    found = detect(documents, fit_dictionaries(documents))
    case = (F.col("passages") > 1) | F.col("label").isNull() | (F.col("label") != F.col("lang"))
    return found.where(case & (F.col("lang") != UNDETERMINED)).select("doc_id", "pos", "lang")


def found(spark: SparkSession, d: str) -> DataFrame:
    """p9_found."""
    return wrong_labels(table(spark, d, "documents"))


def all_languages(spark: SparkSession, d: str) -> DataFrame:
    """Every document and passage with its confidence."""
    return languages(table(spark, d, "documents"))
