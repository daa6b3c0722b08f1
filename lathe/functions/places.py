"""Names of places in free text: tokens, repair of slips, and occurrences of listed names."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache
from math import log

from pyspark.sql import DataFrame

# Abbreviations, words around names, and fields that name no place.
ABBREVIATIONS = {"st": "saint", "ste": "saint", "ft": "fort", "pt": "port", "mt": "mount"}
CONNECTORS = frozenset("and of the de la".split())
ARRANGEMENT = frozenset("remote hybrid onsite on site in person office based work from home wfh flexible fully partly optional first friendly only".split())
AROUND = frozenset("area greater metro metropolitan region city town office hq headquarters headquarter hub campus near downtown center centre in at location".split())
NO_PLACE = frozenset(
    "n/a|na|none|tbd|tba|tbc|-|--|?|various|flexible|anywhere|worldwide|global|multiple locations|see description|to be agreed|remote|hybrid|on site|on-site|onsite|hq|office|"
    "unknown|any|all|everywhere|negotiable|not specified|null|other|several".split("|")
)
_LETTERS = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "ħ": "h", "ŧ": "t"})
_TOKEN = re.compile(r"[^\W_]+", re.UNICODE)


def fold(text: str) -> str:
    """Lower case without accents."""
    if text.isascii():
        return text.lower()
    t = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).lower()).translate(_LETTERS)
    return "".join(c for c in t if not unicodedata.combining(c))


def tokens(text: str) -> list[str]:
    """Folded words, with abbreviations spelled out and connecting words dropped."""
    return [ABBREVIATIONS.get(w, w) for w in _TOKEN.findall(fold(text).replace("&", " and ")) if w not in CONNECTORS]


@lru_cache(maxsize=100_000)
def token(word: str) -> str | None:
    """The token of one word, or null for a connecting word."""
    t = tokens(word)
    return t[0] if t else None


def slips_allowed(word: str) -> int:
    """Slips forgiven in a listed word: one from six letters, two from nine."""
    return 2 if len(word) >= 9 else 1 if len(word) >= 6 else 0


def slips(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between two words, or most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            v = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, older[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def shortened(word: str, most: int) -> set[str]:
    """The word with up to ``most`` letters left out: two words within that many slips share one."""
    out = last = {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


@dataclass(frozen=True)
class Entry:
    """A name of a place (place:id), a country (country:code) or a region (region:country)."""

    ref: str
    kind: str
    country: str
    region: str
    population: int


class Gazetteer:
    """Listed names of places and countries, bounded tables that every task may hold."""

    def __init__(self, places: list[dict], countries: list[dict]):
        self.names: dict[tuple[str, ...], set[Entry]] = defaultdict(set)
        for c in countries:
            e = Entry(f"country:{c['code']}", "country", c["code"], "", c["population"] or 0)
            for n in [c["c1"], c["code"], *(c["other_names"] or [])]:
                self._add(n, e)
        for p in places:
            e = Entry(f"place:{p['geo_id']}", "place", p["country_code"], " ".join(tokens(p["region"] or "")), p["population"] or 0)
            for n in [p["name"], *(p["other_names"] or [])]:
                self._add(n, e)
            self._add(p["region"], Entry(f"region:{p['country_code']}", "region", p["country_code"], e.region, 0))
        #: Words of names to nodes, "" to the entries of a name that ends there.
        self.trie: dict = {}
        for t, entries in self.names.items():
            node = self.trie
            for w in t:
                node = node.setdefault(w, {})
            node[""] = frozenset(entries)
        self.vocabulary = {w for t in self.names for w in t}
        seen: dict[str, int] = defaultdict(int)
        for t in self.names:
            for w in set(t):
                seen[w] += 1
        n = max(len(self.names), 1)
        self.idf = {w: log(1 + n / k) for w, k in seen.items()}
        self.rare = log(1 + n)
        self.repairs: dict[str, list[tuple[str, int]]] = {}
        self._short: dict[str, list[str]] | None = None
        self.spelled = {fold(n).strip() for n in NO_PLACE}

    def _add(self, name: str | None, entry: Entry) -> None:
        t = tuple(tokens(name or ""))
        if t:
            self.names[t].add(entry)

    def repair(self, token: str) -> list[tuple[str, int]]:
        """(listed word, slips) that a token may mean: itself, or the closest within what is forgiven."""
        if token in self.vocabulary:
            return [(token, 0)]
        if len(token) < 5 or token.isdigit() or token in ARRANGEMENT or token in AROUND:
            return []
        if token not in self.repairs:
            if self._short is None:
                self._short = defaultdict(list)
                for w in self.vocabulary:
                    for s in shortened(w, slips_allowed(w)) if slips_allowed(w) else ():
                        self._short[s].append(w)
            near = {w for s in shortened(token, 2) for w in self._short.get(s, ())}
            found = [(w, d) for w in near if (d := slips(token, w, slips_allowed(w))) <= slips_allowed(w)]
            best = min((d for _, d in found), default=0)
            if len(self.repairs) > 300_000:
                self.repairs.clear()
            self.repairs[token] = sorted(x for x in found if x[1] == best)
        return self.repairs[token]

    def occurrences(self, toks: list[str], repairs: list[list[tuple[str, int]]], segment: list[int]) -> list[tuple[int, int, frozenset[Entry], int]]:
        """(from, to, entries, slips) of listed names in a token row, longest first, without overlaps; a name stays in one segment.

        All equally near words of a token are followed at once through the trie of
        names, so their number never multiplies.
        """
        found, i, n = [], 0, len(toks)
        while i < n:
            states, hit, j = [(self.trie, 0)], None, i
            while j < n and segment[j] == segment[i] and repairs[j]:
                reached: dict[int, tuple[dict, int]] = {}
                for node, d in states:
                    for w, e in repairs[j]:
                        child = node.get(w)
                        if child is not None and (id(child) not in reached or d + e < reached[id(child)][1]):
                            reached[id(child)] = (child, d + e)
                if not reached:
                    break
                j += 1
                states = list(reached.values())
                ends = [(d, node[""]) for node, d in states if "" in node]
                if ends:
                    d, entries = min(ends, key=lambda x: x[0])
                    hit = (i, j, entries, d)
            if hit:
                found.append(hit)
                i = hit[1]
            else:
                i += 1
        return found

    def is_placeholder(self, text: str) -> bool:
        return re.sub(r"\s+", " ", fold(text)).strip(" .()") in self.spelled


def gazetteer(places: DataFrame, countries: DataFrame, most: int = 200_000) -> Gazetteer:
    """Read the two reference lists, which must be under ``most`` rows, onto the driver."""
    p = places.select("geo_id", "name", "region", "country_code", "population", "other_names").limit(most + 1).collect()
    c = countries.select("code", "c1", "population", "other_names").limit(most + 1).collect()
    if len(p) + len(c) > most:
        raise ValueError("the reference lists are too long to be held by every task")
    return Gazetteer([r.asDict() for r in p], [r.asDict() for r in c])
