"""URLs: canonical form, tracking parameters, references of job boards."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, quote, quote_plus, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters, and beginnings of such, that only track where a visitor came from.
TRACKING = [
    "_ga", "_gl", "_hsenc", "_hsmi", "dclid", "fbclid", "gbraid", "gclid", "gh_src", "hsctatracking", "igshid", "li_fat_id", "mc_cid", "mc_eid",
    "mkt_tok", "msclkid", "ref", "ref_src", "referer", "referrer", "ttclid", "twclid", "wbraid", "yclid",
]
TRACKING_PREFIXES = ("utm_", "lever-source", "lever-origin", "lever-via")


def is_tracking(name: Column | str) -> Column:
    low = F.lower(F.col(name) if isinstance(name, str) else name)
    out = low.isin(TRACKING)
    for p in TRACKING_PREFIXES:
        out = out | low.startswith(p)
    return out


def canonical(url: str | None) -> str | None:
    """Canonical absolute http(s) URL, or null: host in lower case without default port,
    credentials, trailing dot, tracking parameters and ends of slashes; parameters sorted
    by name; fragments kept only if they are routes."""
    text = re.sub(r"[\t\r\n]", "", (url or "").strip())
    try:
        u = urlsplit(text)
        port = u.port
        host = (u.hostname or "").rstrip(".")
        host = host.encode("idna").decode() if not host.isascii() else host
    except (ValueError, UnicodeError):
        return None
    scheme = u.scheme.lower()
    if scheme not in ("http", "https") or not host or re.search(r"[\s<>^|%]", host):
        return None
    if ":" in host:
        host = f"[{host}]"
    if port is not None and port != {"http": 80, "https": 443}[scheme]:
        host += f":{port}"
    path, parts = quote(u.path, safe="/%:@!$&'()*+,;=~[]|"), []
    for seg in path.split("/"):  # dot segments
        if seg in (".", "%2e", "%2E"):
            continue
        if seg == "..":
            parts = parts[:-1] if len(parts) > 1 else parts
            continue
        parts.append(seg)
    path = "/".join(parts) or "/"
    path = path if path.startswith("/") else "/" + path
    path = path.rstrip("/") or "/"
    pairs = [(k, v) for k, v in parse_qsl(u.query, keep_blank_values=True) if k and k.lower() not in TRACKING and not k.lower().startswith(TRACKING_PREFIXES)]
    pairs.sort(key=lambda kv: kv[0])
    query = "?" + "&".join(f"{_form(k)}={_form(v)}" for k, v in pairs) if pairs else ""
    fragment = "#" + quote(u.fragment, safe="/%:@!$&'()*+,;=~?") if u.fragment.startswith(("/", "!/")) else ""
    return f"{scheme}://{host}{path}{query}{fragment}"


def _form(s: str) -> str:
    return quote_plus(s, safe="*-._").replace("~", "%7E")


def canonical_url(c: Column | str) -> Column:
    """``canonical`` over Arrow batches; null for texts that are no http(s) URL."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(canonical)

    return run(c)


def host(c: Column | str) -> Column:
    return F.lower(F.expr("try_parse_url({c}, 'HOST')".format(c=c)) if isinstance(c, str) else F.try_parse_url(c, F.lit("HOST")))


def job_reference(c: Column | str) -> Column:
    """struct<system,id> that a posting's URL names, else null: by host, path and query of the public boards."""
    c = F.col(c) if isinstance(c, str) else c
    h, path = host(c), F.coalesce(F.try_parse_url(c, F.lit("PATH")), F.lit(""))
    ref = lambda system, i: F.struct(F.lit(system).alias("system"), i.alias("id"))
    uuid = r"/([0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12})"
    greenhouse = F.coalesce(F.nullif(F.regexp_extract(path, r"/jobs/(\d+)", 1), F.lit("")), F.try_parse_url(c, F.lit("QUERY"), F.lit("gh_jid")), F.try_parse_url(c, F.lit("QUERY"), F.lit("token")))
    other = F.try_parse_url(c, F.lit("QUERY"), F.lit("gh_jid"))
    found = F.lower(F.regexp_extract(path, uuid, 1))
    return (
        F.when(h.endswith("greenhouse.io") & greenhouse.isNotNull(), ref("greenhouse", greenhouse))
        .when(h.endswith("ashbyhq.com") & (found != ""), ref("ashby", found))
        .when(h.endswith("lever.co") & (found != ""), ref("lever", found))
        .when(other.isNotNull(), ref("greenhouse", other))
    )


def board_reference(c: Column | str) -> Column:
    """struct<system,board> of a board's or a posting's URL, else null."""
    c = F.col(c) if isinstance(c, str) else c
    h, path = host(c), F.coalesce(F.try_parse_url(c, F.lit("PATH")), F.lit(""))
    first = F.lower(F.regexp_extract(path, r"^/(?:v1/boards/|posting-api/job-board/|v0/postings/)?([\w.%-]+)", 1))
    system = F.when(h.endswith("greenhouse.io"), "greenhouse").when(h.endswith("ashbyhq.com"), "ashby").when(h.endswith("lever.co"), "lever")
    return F.when(system.isNotNull() & (first != "") & ~first.isin("embed", "jobs"), F.struct(system.alias("system"), first.alias("board")))
