"""Markup: readable text, links, embedded postings, sitemaps and robots rules."""

from __future__ import annotations

import json
import re
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements without visible text, elements set off by a blank line, elements on a line of their own.
SKIPPED = frozenset("script style head title noscript template".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure section article header footer hr".split())
LINES = frozenset("div tr dt dd li figcaption address".split())
_REFERENCE = re.compile(r"&(#[xX]?[0-9a-fA-F]{1,8}|[A-Za-z][A-Za-z0-9]{1,9});")
_GONE = dict.fromkeys(map(ord, "\u00ad\u200b\x00\x01"))


def decode(text: str) -> str:
    """Character references with a semicolon; unknown ones stay, soft hyphens and zero-width spaces go."""

    def one(m: re.Match) -> str:
        name = m[1]
        if name[0] != "#":
            return html5.get(name + ";", m[0])
        try:
            code = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
            return chr(code) if code and not 0xD800 <= code <= 0xDFFF else m[0]
        except (ValueError, OverflowError):
            return m[0]

    return _REFERENCE.sub(one, text).translate(_GONE)


class _Block:
    """An element with its texts and elements in order."""

    __slots__ = ("kids", "tag")

    def __init__(self, tag: str):
        self.tag = tag
        self.kids: list = []


#: Elements that have no end, deepest nesting that is kept apart, signs that stand for a line end and for a blank to keep.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_DEEPEST = 150
_END, _KEPT = "\x00", "\x01"
#: Open elements that the start of another one ends, up to the elements that hold them.
_ENDS_OPEN = {"li": ("li", "ul ol"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tr": ("tr", "table"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "p": ("p", "li td th div blockquote")}


class _Tree(HTMLParser):
    """Markup as a tree of blocks; missing ends are supplied, and ends without a start ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.root = _Block("")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        ended, held = _ENDS_OPEN.get(tag, ("p", "li td th div blockquote") if tag in PARAGRAPHS or tag in LINES else ("", ""))
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in ended.split():
                del self.open[i:]
                break
            if self.open[i].tag in held.split():
                break
        one = _Block(tag)
        self.open[-1].kids.append(one)
        if tag not in _VOID and len(self.open) < _DEEPEST:
            self.open.append(one)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.open[-1].tag == tag and tag not in _VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")

    def handle_data(self, data):
        self.open[-1].kids.append(data)


class _Page:
    """Lines of a tree, each with the number of line ends before it."""

    def __init__(self, depth: int = 0, kept: bool = False):
        self.lines: list[tuple[int, str]] = []
        self.run: list[str] = []
        self.due, self.depth, self.kept = 0, depth, kept

    def close_run(self) -> None:
        """Lay what was gathered on a line: blanks run together, and a run without words is a gap if it has any sign."""
        whole, self.run = "".join(self.run), []
        parts = [" ".join(x.split()) for x in whole.split(_END)]
        said = [i for i, x in enumerate(parts) if x]
        if not said:
            self.due = 2 if "\u00a0" in whole else min(self.due + len(parts) - 1, 2)
            return
        for i in range(said[0], said[-1] + 1):
            if parts[i]:
                before = i - max((j for j in said if j < i), default=i)
                self.lines.append((min(before, 2) if before else min(max(self.due, said[0] and self.due + said[0]), 2), parts[i]))
        self.due = min(len(parts) - 1 - said[-1], 2)

    def gap(self, n: int) -> None:
        self.close_run()
        self.due = max(self.due, n)

    def add(self, block: _Block) -> None:
        for kid in block.kids:
            if isinstance(kid, str):
                text = decode(kid)
                self.run.append(text.replace("\r\n", "\n").replace("\n", _END).replace(" ", _KEPT) if self.kept else text)
            elif kid.tag in SKIPPED:
                continue
            elif kid.tag == "br":
                self.run.append(_END)
            elif kid.tag in ("ul", "ol"):
                self.items(kid)
            elif kid.tag == "tr":
                self.row(kid)
            else:
                n = 2 if kid.tag in PARAGRAPHS else 1 if kid.tag in LINES else 0
                kept, self.kept = self.kept, self.kept or kid.tag == "pre"
                if n:
                    self.gap(n)
                self.add(kid)
                if n:
                    self.gap(n)
                self.kept = kept

    def items(self, block: _Block) -> None:
        """Items one below the other, whatever blocks they are made of, with bullets or numbers and two blanks a level."""
        outer = 1 if self.depth else 2
        self.gap(outer)
        number = 0
        for kid in block.kids:
            if isinstance(kid, _Block) and kid.tag == "li":
                number += 1
                inner = _Page(self.depth + 1, self.kept)
                inner.add(kid)
                inner.close_run()
                mark = "  " * self.depth + (f"{number}. " if block.tag == "ol" else "• ")
                for i, (_, line) in enumerate(inner.lines):
                    self.lines.append((1 if self.lines and i else max(self.due, 1), line if i else mark + line.lstrip()))
                    self.due = 1
            else:
                self.add(_holding(kid))
                self.gap(1)
        self.gap(outer)

    def row(self, block: _Block) -> None:
        cells = []
        for kid in block.kids:
            one = _Page(self.depth, self.kept)
            one.add(kid if isinstance(kid, _Block) and kid.tag in ("td", "th") else _holding(kid))
            one.close_run()
            cells.append(" ".join(line for _, line in one.lines))
        self.gap(1)
        self.run.append(" | ".join(c for c in cells if c))
        self.gap(1)


def _holding(kid) -> _Block:
    one = _Block("")
    one.kids.append(kid)
    return one


def to_text(markup: str | None, escaped: bool = False) -> str | None:
    """Readable text of markup: paragraphs apart, items with bullets or numbers, cells apart; null if none remains.

    Line ends and blanks of preformatted text stay. Markup that is broken keeps its words.
    """
    if not markup:
        return None
    tree = _Tree()
    try:
        tree.feed(decode(markup) if escaped else markup)
        tree.close()
    except AssertionError:  # markup that the parser gives up on stays as it is
        return markup.strip() or None
    page = _Page()
    page.add(tree.root)
    page.close_run()
    text = "".join("\n" * (n if i else 0) + line for i, (n, line) in enumerate(page.lines))
    return "\n".join(x.rstrip() for x in text.replace(_KEPT, " ").split("\n")).strip() or None


def html_to_text(c: Column | str, escaped: bool = False) -> Column:
    """``to_text`` over Arrow batches; ``escaped`` markup is decoded once first."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: to_text(x, escaped))

    return run(c)


def absolute_urls(c: Column | str) -> Column:
    """array<string>: every absolute http(s) URL of a page in order, JVM-side."""
    return F.regexp_extract_all(c, F.lit(r"""(https?://[^\s"'<>\\)\]}]+)"""), 1)


def embedded_postings(c: Column | str) -> Column:
    """array<struct<...>>: JobPosting objects in a page's linked-data scripts, however nested."""
    kind = "array<struct<title:string,company:string,url:string,date_posted:string,valid_through:string,locality:string,country:string,remote:boolean,description:string>>"

    def walk(x):
        if isinstance(x, list):
            for y in x:
                yield from walk(y)
        elif isinstance(x, dict):
            t = x.get("@type")
            if t == "JobPosting" or (isinstance(t, list) and "JobPosting" in t):
                yield x
            else:
                for y in x.values():
                    yield from walk(y)

    def text(x, *keys):
        for k in keys:
            x = x[0] if isinstance(x, list) and x else x
            x = x.get(k) if isinstance(x, dict) else None
        x = x.get("name") if isinstance(x, dict) else x
        return x if isinstance(x, str) and x.strip() else None

    def read(page):
        if page is None:
            return None
        out = []
        for m in re.finditer(r"<script[^>]*application/ld\+json[^>]*>(.*?)</script>", page, re.I | re.S):
            try:
                data = json.loads(m[1].strip())
            except ValueError:
                continue
            for p in walk(data):
                out.append({
                    "title": text(p, "title"), "company": text(p, "hiringOrganization"), "url": text(p, "url"), "date_posted": text(p, "datePosted"), "valid_through": text(p, "validThrough"),
                    "locality": text(p, "jobLocation", "address", "addressLocality"), "country": text(p, "jobLocation", "address", "addressCountry"),
                    "remote": text(p, "jobLocationType") == "TELECOMMUTE", "description": to_text(text(p, "description"), True),
                })
        return out

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(read)

    return run(c)


def sitemap_urls(c: Column | str) -> Column:
    """struct<is_index, urls> of a sitemap document; broken XML gives what can be read."""
    c = F.col(c) if isinstance(c, str) else c
    locs = F.transform(F.regexp_extract_all(c, F.lit(r"(?s)<loc>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</loc>"), 1), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))
    return F.struct(c.rlike(r"<sitemapindex\b").alias("is_index"), locs.alias("urls"))


def disallowed(robots: Column | str) -> Column:
    """array<string>: path beginnings that a robots file closes to all agents; asterisks at the end mean nothing.

    Several agents may share a group; comments, unknown fields and blank rules count for nothing.
    """
    c = F.col(robots) if isinstance(robots, str) else robots
    text = F.concat(F.regexp_replace(F.regexp_replace(c, r"#[^\n\r]*", ""), r"\s*[\r\n]+\s*", "\n"), F.lit("\n"))
    groups = F.regexp_extract_all(text, F.lit(r"(?im)((?:^user-agent[ \t]*:[^\n]*\n)+(?:^(?!user-agent[ \t]*:)[^\n]*\n)*)"), 1)
    ours = F.filter(groups, lambda g: g.rlike(r"(?im)^user-agent[ \t]*:[ \t]*\*[ \t]*$"))
    paths = F.regexp_extract_all(F.array_join(ours, "\n"), F.lit(r"(?im)^disallow[ \t]*:[ \t]*(\S+)"), 1)
    return F.filter(F.transform(paths, lambda p: F.regexp_replace(p, r"\*+$", "")), lambda p: p != "")


def robots_sitemaps(robots: Column | str) -> Column:
    """array<string>: sitemaps that a robots file names."""
    return F.regexp_extract_all(robots, F.lit(r"(?im)^[ \t]*sitemap[ \t]*:[ \t]*(\S+)"), 1)


def allowed(path: Column | str, closed: Column | str) -> Column:
    p = F.col(path) if isinstance(path, str) else path
    return ~F.exists(closed, lambda x: p.startswith(x))
