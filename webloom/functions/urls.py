"""Urls: canonical form, domain, links of a page, short form for display.

Canonical form: resolved against the base, http and https only, no fragment, scheme and host in lower case, query sorted by key,
own default port dropped, trailing slashes dropped.  Keys without a value are dropped from a query; repeated keys,
whatever their case, merge into the first spelling with values joined by a comma.  Non-ASCII stays as it is.
"""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import parse_qsl, quote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DEFAULT_PORT = {"http": 80, "https": 443}


def _sorted_query(query: str) -> str:
    merged: dict[str, list] = {}
    for key, value in parse_qsl("&".join(p for p in query.split("&") if "=" in p), keep_blank_values=True):
        merged.setdefault(key.lower(), [key, []])[1].append(value)
    pairs = sorted((key, ",".join(values)) for key, values in merged.values())
    return "&".join(f"{quote(k, safe='~')}={quote(v, safe='~')}" for k, v in pairs)


def normalize_url(raw: str | None, base: str | None) -> str | None:
    """The canonical url, or None where it can't be one."""
    try:
        if raw is None:
            return None
        parts = urlsplit(urljoin(base or "", raw.strip()))
        scheme = parts.scheme.lower()
        if scheme not in _DEFAULT_PORT or not parts.hostname:
            return None
        port = parts.port
        host = parts.hostname.lower()
        host = f"[{host}]" if ":" in host else host
        user = parts.netloc.rpartition("@")[0]
        place = (user + "@" if user else "") + host + ("" if port is None or port == _DEFAULT_PORT[scheme] else f":{port}")
        query = _sorted_query(parts.query)
        return f"{scheme}://{place}{parts.path}{'?' + query if query else ''}".rstrip("/")
    except ValueError:
        return None


def normalize(raw: Column, base: Column) -> Column:
    @F.pandas_udf("string")
    def run(urls: pd.Series, bases: pd.Series) -> pd.Series:
        return pd.Series([normalize_url(u, b) for u, b in zip(urls, bases, strict=True)], dtype=object)

    return run(raw, base)


def host_of(url: str) -> str:
    """domain() of a canonical url, here on the driver."""
    return (urlsplit(url).hostname or "").lower()


def domain(url: Column) -> Column:
    """Lower-case host of a canonical url, without user and port."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/:?#]+)", 1))


class _Links(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            href = next((v for k, v in attrs if k == "href"), None)
            if href is not None and href.strip():
                self.found.append(href)


def links_of(html: str | None, base: str | None) -> list[str]:
    """Canonical links of a page, in the order of the page, repeated ones kept."""
    parser = _Links()
    parser.feed(html or "")
    parser.close()
    return [u for u in (normalize_url(x, base) for x in parser.found) if u is not None]


def extract_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages with a column OutLinks, parsed as HTML in Arrow batches."""

    @F.pandas_udf("array<string>")
    def run(htmls: pd.Series, bases: pd.Series) -> pd.Series:
        return pd.Series([links_of(h, b) for h, b in zip(htmls, bases, strict=True)], dtype=object)

    return pages.withColumn("OutLinks", run(F.col(html_col), F.col(url_col)))


@F.udtf(returnType="pos int, link string")
class ExtractLinks:
    """links_of() as a table function: SELECT * FROM pages, LATERAL extract_links(html, url), once registered by register()."""

    def eval(self, html: str, base: str):
        for pos, link in enumerate(links_of(html, base)):
            yield pos, link


def register(spark) -> None:
    spark.udtf.register("extract_links", ExtractLinks)


def fast_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per raw href, (url, pos, href), inside the JVM: an attribute of its own (not data-href), quoted or not; entities stay as they are."""
    bare = F.regexp_replace(F.col(html_col), r"(?is)<!--.*?-->|<script\b.*?</script>", "")
    # one group for the value with its quotes, which go after
    found = F.regexp_extract_all(bare, F.lit(r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""), 1)
    found = F.transform(found, lambda x: F.regexp_replace(x, r"""^["']|["']$""", ""))
    rows = pages.select(F.col(url_col).alias("url"), F.posexplode(found).alias("pos", "href"))
    return rows.filter(F.trim("href") != "")


def shorten(url: Column, width: int = 60) -> Column:
    """Without scheme and one trailing slash, cut to `width` characters with an ellipsis."""
    bare = F.regexp_replace(F.regexp_replace(url, "^https?://", ""), "/$", "")
    return F.when(F.length(bare) > width, F.concat(F.substring(bare, 1, width - 1), F.lit("…"))).otherwise(bare)


