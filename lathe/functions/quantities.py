"""Quantities in wording: amounts with currency, scale and interval, weights, distances, durations."""

from __future__ import annotations

import re
from functools import lru_cache

# Wording of currencies, intervals and units.
CURRENCY_SIGNS = {"$": "USD", "€": "EUR", "£": "GBP", "₹": "INR", "¥": "JPY", "zł": "PLN"}
CURRENCY_CODES = "USD EUR GBP INR PLN CHF JPY CAD AUD NZD SEK NOK DKK CZK HUF BRL MXN SGD HKD CNY ZAR".split()
INTERVAL_WORDS = {
    "hour": ["per hour", "an hour", "a hour", "/hour", "/hr", "/h", "hourly", "p/h", "p.h."],
    "day": ["per day", "a day", "/day", "/d", "daily", "p/d", "p.d."],
    "week": ["per week", "a week", "/week", "/wk", "/w", "weekly", "p/w", "p.w."],
    "month": ["per month", "a month", "/month", "/mo", "monthly", "p.m.", "pcm"],
    "year": ["per year", "a year", "per annum", "/year", "/yr", "/y", "yearly", "annually", "annual", "p.a."],
}
#: Intervals in a year.
PER_YEAR = {"hour": 2080, "day": 260, "week": 52, "month": 12, "year": 1}
#: Grams, metres and months of each unit.
WEIGHTS = {"kg": 1000.0, "kilo": 1000.0, "kilos": 1000.0, "kilogram": 1000.0, "kilograms": 1000.0, "g": 1.0, "gram": 1.0, "grams": 1.0,
           "lb": 453.59237, "lbs": 453.59237, "pound": 453.59237, "pounds": 453.59237, "stone": 6350.29318, "stones": 6350.29318}
DISTANCES = {"km": 1000.0, "kilometre": 1000.0, "kilometres": 1000.0, "kilometer": 1000.0, "kilometers": 1000.0, "m": 1.0, "metre": 1.0, "metres": 1.0,
             "meter": 1.0, "meters": 1.0, "mi": 1609.344, "mile": 1609.344, "miles": 1609.344}
MONTHS = {"year": 12.0, "years": 12.0, "yr": 12.0, "yrs": 12.0, "month": 1.0, "months": 1.0, "mo": 1.0, "mos": 1.0, "week": 12 / 52, "weeks": 12 / 52, "wks": 12 / 52}
NUMBER_WORDS = {w: i + 1 for i, w in enumerate("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
NUMBER_WORDS |= {w: 20 + 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split())} | {"hundred": 100, "half": 0.5}
#: Words by which a duration is one of experience, an amount one of pay.
EXPERIENCE_CUES = ["experience", "practice", "tenure", "track record", "comparable role", "similar role", "background", "in the field"]
PAY_CUES = ["salary", "pay", "compensation", "earn", "offer", "range", "band", "cash target", "budget", "wage", "rate"]

NUMBER = r"(?:\d{1,3}(?:,\d{2,3})*,\d{3}(?!\d)(?:\.\d+)?|\d{1,3}(?:[.'’ \u00a0\u202f\u2009]\d{3})+(?!\d)(?:,\d+)?|\d+(?:[.,]\d+)?)"
_NOT_INSIDE = r"(?<![\w.,$€£₹])"


def number(text: str, scaled: bool = False) -> float:
    """Value of a NUMBER; with a scale word behind it a point is always decimal."""
    if text[0].isalpha():
        return float(sum(NUMBER_WORDS[w] for w in re.split(r"[\s-]+", text.lower())))
    text = re.sub(r"[\s'’]", "", text)
    if scaled and text.count(".") == 1 and "," not in text:
        return float(text)
    if re.fullmatch(r"\d{1,3}(?:,\d{2,3})*,\d{3}(?:\.\d+)?", text):
        return float(text.replace(",", ""))
    if re.fullmatch(r"\d{1,3}(?:\.\d{3})+(?:,\d+)?", text):
        return float(text.replace(".", "").replace(",", "."))
    return float(text.replace(",", "."))


@lru_cache(maxsize=1)
def _patterns():
    signs = "|".join(map(re.escape, sorted(CURRENCY_SIGNS, key=len, reverse=True)))
    cur = rf"(?:{signs}|\b(?:{'|'.join(CURRENCY_CODES)})\b)"
    words = sorted(((w, k) for k, ws in INTERVAL_WORDS.items() for w in ws), key=lambda x: -len(x[0]))
    interval = "|".join(re.escape(w).replace(r"\ ", r"\s+") + ("" if w.endswith(".") else r"\b") for w, _ in words)
    scale = r"(?:k\b|lakh\b|thousand\b|m\b|mn\b|million\b|bn\b|billion\b)"
    s = r"\s{0,3}"
    money = re.compile(
        rf"(?:\b(?P<before>annual|yearly|monthly|weekly|daily|hourly)\s+)?(?P<c1>{cur})?{s}(?<![\w.,])(?P<n1>{NUMBER}){s}(?P<k1>{scale})?{s}(?P<c2>{cur})?"
        rf"(?:{s}(?:-|–|—|to\b){s}(?P<c3>{cur})?{s}(?P<n2>{NUMBER}){s}(?P<k2>{scale})?{s}(?P<c4>{cur})?)?(?:{s}(?P<iv>{interval}))?",
        re.IGNORECASE,
    )
    of_word = {re.sub(r"\s+", " ", w): k for w, k in words}
    units = {**{u: ("weight", f) for u, f in WEIGHTS.items()}, **{u: ("distance", f) for u, f in DISTANCES.items()}, **{u: ("experience", f) for u, f in MONTHS.items()}}
    word = "|".join(sorted(NUMBER_WORDS, key=len, reverse=True))
    count = rf"(?:{NUMBER}|(?:{word})(?:[\s-](?:{word}))?\b)"
    measure = re.compile(
        rf"{_NOT_INSIDE}(?P<n1>{count})(?:\s?(?:-|–|—|to)\s?(?P<n2>{count}))?\s?\+?\s?-?\s?(?P<u>{'|'.join(sorted(units, key=len, reverse=True))})\b(?!\s*/|²|³|\^)", re.IGNORECASE
    )
    return money, of_word, units, measure, re.compile(cur, re.IGNORECASE)


#: Characters around a currency within which its amount must stand; no amount is as long.
_NEAR = 200


def _money_in(text: str):
    """Matches of the money pattern, looked for around currencies only."""
    money, sign = _patterns()[0], _patterns()[4]
    lo, hi = 0, -1
    for m in sign.finditer(text):
        if m.start() - _NEAR > hi:
            if hi > 0:
                yield from money.finditer(text, lo, hi)
            lo = max(0, m.start() - _NEAR)
        hi = m.end() + _NEAR
    if hi > 0:
        yield from money.finditer(text, lo, hi)


SCALES = {"k": 1e3, "thousand": 1e3, "lakh": 1e5}


def amounts(text: str | None, cues_needed: bool) -> list[tuple[str | None, str | None, float, float]]:
    """(currency, interval, lo, hi) of the amounts of money a text states.

    Millions and above are sums about a company. With ``cues_needed`` an amount
    without an interval counts only in a sentence that speaks of pay.
    """
    if not text:
        return []
    of_word = _patterns()[1]
    out = []
    for m in _money_in(text):
        signs = [m[c] for c in ("c1", "c2", "c3", "c4") if m[c]]
        if not signs:
            continue
        interval = of_word.get(re.sub(r"\s+", " ", (m["iv"] or m["before"] or "").lower().strip()))
        scales = [(m[k] or "").lower() for k in ("k1", "k2")]
        if any(k and k not in SCALES for k in scales):
            continue
        if interval is None and cues_needed:
            start, end = max(text.rfind(c, 0, m.start()) for c in ".!?\n") + 1, m.end()
            if not any(c in text[start:end].lower() for c in PAY_CUES):
                continue
        code = signs[0].lower()
        code = next((v for k, v in CURRENCY_SIGNS.items() if k == code), code.upper())
        last = scales[1] or (scales[0] if m["n2"] is None else "")
        first = scales[0] or last
        last = last or (scales[0] if m["n2"] and number(m["n2"]) < 1000 else "")
        lo = number(m["n1"], bool(first)) * SCALES.get(first, 1)
        hi = number(m["n2"], bool(last)) * SCALES.get(last, 1) if m["n2"] else lo
        out.append((code, interval, lo, hi))
    return out


def measures(text: str | None) -> list[tuple[str, float, float]]:
    """(quantity, lo, hi) of lifted weights (g), distances (m) and required experience (months)."""
    if not text:
        return []
    _, _, units, measure, _ = _patterns()
    out = []
    for m in measure.finditer(text):
        quantity, factor = units[m["u"].lower()]
        if quantity == "experience":
            start = max(text.rfind(c, 0, m.start()) for c in "!?\n") + 1
            dot = [x.end() for x in re.finditer(r"\.\s", text[start : m.start()])]
            start += dot[-1] if dot else 0
            stop = re.search(r"\.\s|[!?\n]|$", text[m.end() + 1 :])
            around = re.sub(r"\s+", " ", text[start : m.end() + 1 + stop.start()]).lower()
            if re.match(r"\s+old\b|\s+ago\b", text[m.end() :], re.IGNORECASE) or not any(c in around for c in EXPERIENCE_CUES):
                continue
        elif re.search(r"square\s*$", text[: m.end()][: m.start("u")], re.IGNORECASE):
            continue
        lo = number(m["n1"]) * factor
        out.append((quantity, lo, number(m["n2"]) * factor if m["n2"] else lo))
    return out
