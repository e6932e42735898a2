"""Web-facing pieces: addresses, politeness, fetching, site maps. Fetching is control-plane work on the driver."""

from __future__ import annotations

import random
import time
import urllib.error
import urllib.request
from urllib.parse import urljoin as _urljoin
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

#: Path words that point to a detail page, and routes that never are one.
DETAIL_WORDS = ("plant", "plants", "phytochemical", "phytochemicals", "compound", "compounds", "species", "detail", "details")
OTHER_ROUTES = ("/admin/", "/login", "/register", "/search", "/about", "/contact", "/feedback", "/robots.txt", "/sitemap")
RETRY_STATUS = (429, 500, 502, 503, 504)


def detail_url(c: Column) -> Column:
    """True for web addresses whose path holds a detail word and no other route."""
    path = F.lower(F.coalesce(F.try_parse_url(c, F.lit("PATH")), F.lit("")))
    hit = F.arrays_overlap(F.split(path, "[/_-]+"), F.array(*(F.lit(w) for w in DETAIL_WORDS)))
    other = F.lit(False)
    for r in OTHER_ROUTES:
        other = other | path.contains(r)
    return F.coalesce(c.rlike("^https?://") & hit & ~other, F.lit(False))


def cache_key(c: Column, length: int = 24) -> Column:
    """Content address of a cached page: the head of the SHA-256 of its address."""
    return F.substring(F.sha2(c, 256), 1, length)


@F.pandas_udf(T.StringType())
def urljoin(base: pd.Series, link: pd.Series) -> pd.Series:
    """A link resolved against its page."""
    return pd.Series([None if b is None or x is None else _urljoin(b, x) for b, x in zip(base, link)])


def robots(text: str, base: str) -> RobotFileParser:
    """Rules of a robots file; an empty one allows everything."""
    p = RobotFileParser(base)
    p.parse(text.splitlines())
    return p


def fetch(url: str, rules: RobotFileParser | None = None, agent: str = "quillwork", retries: int = 4, pause: float = 1.0, timeout: float = 30.0, jitter: tuple[float, float] = (0.0, 0.0), opener=urllib.request.urlopen, sleep=time.sleep, draw=random.uniform) -> tuple[int, str]:
    """Status and body of a page: waits twice as long after every refusal and a random time between the bounds of ``jitter`` more, asks the robots rules first.

    Returns status 0 where the rules forbid the page or no attempt got an answer.
    """
    if rules is not None and not rules.can_fetch(agent, url):
        return 0, ""
    for attempt in range(retries + 1):
        try:
            with opener(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=timeout) as r:
                return r.status, r.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            if e.code not in RETRY_STATUS:
                return e.code, ""
            status = e.code
        except (urllib.error.URLError, TimeoutError):
            status = 0
        if attempt < retries:
            sleep(pause * 2**attempt + draw(*jitter))
    return status, ""


def sitemap_urls(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """Adds ``kind`` (index or urlset) and explodes ``loc``, the addresses a site map lists; unreadable maps list none."""
    bare = F.regexp_replace(F.col(xml), r"\sxmlns(:\w+)?=\"[^\"]*\"", "")
    kind = F.when(bare.rlike(r"<(\w+:)?sitemapindex[\s>]"), "index").when(bare.rlike(r"<(\w+:)?urlset[\s>]"), "urlset")
    locs = F.transform(F.expr(f"regexp_extract_all(regexp_replace({xml}, '\\\\sxmlns(:\\\\w+)?=\"[^\"]*\"', ''), '<(?:\\\\w+:)?loc>\\\\s*([^<]*?)\\\\s*</', 1)"), lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))
    return docs.select("*", kind.alias("kind"), F.explode(locs).alias("loc"))


def expand_sitemaps(docs: DataFrame, roots: list[str], max_depth: int = 1_000) -> DataFrame:
    """All page addresses reached from the root maps through index maps; ``docs`` has ``url`` and ``xml``.

    Maps already visited are not read again, so circular indexes end. Maps that are still
    unread after ``max_depth`` levels are an error.
    """
    spark = docs.sparkSession
    listed = materialize(sitemap_urls(docs).select("url", "kind", "loc"), "listed")
    frontier = spark.createDataFrame([(r,) for r in roots], "url string").distinct()
    visited = frontier
    for _ in range(max_depth):
        hit = listed.filter("kind = 'index'").join(frontier, "url", "left_semi")
        frontier = materialize(hit.select(F.col("loc").alias("url")).distinct().join(visited, "url", "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    else:
        raise RuntimeError(f"site maps nested deeper than {max_depth} levels")
    return listed.filter("kind = 'urlset'").join(visited, "url", "left_semi").select("loc").distinct()
