"""URL filters whose decisions reach the aliases of a page.

A rule names a host and the beginning of a path; the longest one that fits decides. Pages that redirect to each
other, name each other as canonical, or have one canonical form are the same document: they are the connected
components of these links. A page without a rule of its own is blocked if a page of its component is, unless another
one is explicitly allowed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.components import components
from cohortlab.llm.tables import ascii_lower, field, keep, numbered

ALLOW, BLOCK = "allow", "block"
# Host prefixes and query fields that do not change which document is meant.
SAME_HOST = r"^(?:www|m)\."
TRACKING = r"(?:^|&)(?:utm_[a-z]+|ref|gclid|fbclid)=[^&]*"
_TAG = r'(?is)<{0}\b[^<>]*?\b{1}\s*=\s*["\']?{2}\b[^<>]*>'
_CANONICAL = _TAG.format("link", "rel", "canonical")
_REFRESH = _TAG.format("meta", "http-equiv", "refresh")
_HREF = r'(?is)\bhref\s*=\s*["\']?([^"\'\s<>]+)'
_URL = r'(?is)\burl\s*=\s*["\']?([^"\'\s<>]+)'


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains and a beginning of the path. Rules are a list in the plan, for up to
    some hundreds of them."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule(ALLOW, "com"), Rule(BLOCK, "example.com", "/en/"), Rule(ALLOW, "www.example.com", "/en/"),
    Rule(BLOCK, "net", "/es/"), Rule(BLOCK, "net", "/fr/"),
)


def host(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host and path without scheme, common host prefixes, last slash, fragment and tracking fields."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, TRACKING, ""), "^&", "")
    place = F.concat(F.regexp_replace(host(url), SAME_HOST, ""), F.regexp_replace(path(url), "/$", ""))
    full = F.when(query == "", place).otherwise(F.concat(place, F.lit("?"), query))
    return F.when(host(url) == "", None).otherwise(full)


def _resolved(target: Column, page: Column) -> Column:
    """An absolute url from a link on a page; null without one."""
    target = F.replace(target, F.lit("&amp;"), F.lit("&"))
    site = F.concat(F.lit("http://"), host(page))
    folder = F.regexp_extract(path(page), r"(?s)^(.*/)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when(target == "", None).when(target.contains("://"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(site, target)).otherwise(F.concat(site, folder, target))
    )


def fitting(url_host: Column, url_path: Column, rules: Sequence[Rule], value: str) -> Column:
    """``name`` or ``verdict`` of the longest rule that fits, null if none does; allow goes first among equals."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.verdict == ALLOW, r.name)):
        fits = ((url_host == r.host) | url_host.endswith("." + r.host)) & url_path.startswith(r.path)
        out = F.when(fits, F.lit(getattr(r, value))).otherwise(out)
    return out


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """``(page_id, host, path, rule, verdict, decided_by)`` for each row of ``pages(page_id, url, html)``.

    Links are the canonical and refresh links in ``html`` (a table without that column has none) and the rows of
    ``redirects(source, target)``, if given. ``rule`` is null where the method decides; ``decided_by`` is ``rule``,
    ``alias`` or ``default``.

    Null url, or one without ``://``: host and path empty, no rule, no aliases, allowed. Null html: no links. Null
    ids and repeated rows each get their result. Very long urls and pages are read whole; of several canonical links
    the first counts. An empty table gives no rows. Other columns are not used.
    """
    url = field("url").cast("string")
    html = field("html").cast("string") if "html" in pages.columns else F.lit(None).cast("string")
    named = F.regexp_extract(F.regexp_extract(html, _CANONICAL, 0), _HREF, 1)
    led = F.regexp_extract(F.regexp_extract(html, _REFRESH, 0), _URL, 1)
    rows = pages.select(
        field("page_id").alias("page_id"), host(url).alias("host"), path(url).alias("path"),
        canonical(url).alias("key"), canonical(_resolved(named, url)).alias("named"),
        canonical(_resolved(led, url)).alias("led"),
    )
    rows = keep(rows.select(
        "*", fitting(F.col("host"), F.col("path"), rules, "name").alias("rule"),
        fitting(F.col("host"), F.col("path"), rules, "verdict").alias("ruled"),
    ), "pages")
    links = rows.select("key", F.explode(F.array("named", "led")).alias("other"))
    if redirects is not None:
        given = redirects.select(canonical(field("source")).alias("key"), canonical(field("target")).alias("other"))
        links = links.unionByName(given)
    links = keep(links.where("key != other").distinct(), "aliases")
    names = numbered(links.select("key").union(links.select("other")).distinct(), "names")
    ends = links.join(names.toDF("key", "a"), "key").join(names.toDF("other", "b"), "other").select("a", "b")
    linked = names.join(components(ends), "node", "left").select(
        "key", F.coalesce("label", "node").cast("string").alias("label")
    )
    # Numbers and keys cannot be mixed up: a key never begins with a blank.
    component = F.coalesce(F.concat(F.lit(" "), "label"), F.col("key")).alias("component")
    rows = rows.join(linked, "key", "left").select("page_id", "host", "path", "rule", "ruled", component)
    said = rows.where("ruled is not null").groupBy("component").agg(
        F.max(F.col("ruled") == BLOCK).alias("blocked"), F.max(F.col("ruled") == ALLOW).alias("allowed")
    )
    alias = F.col("blocked") & ~F.col("allowed")
    verdict = F.coalesce("ruled", F.when(alias, BLOCK).otherwise(ALLOW))
    reason = F.when(F.col("ruled").isNotNull(), "rule").when(F.col("blocked").isNotNull(), "alias")
    return rows.join(said, "component", "left").select(
        "page_id", "host", "path", "rule", verdict.alias("verdict"), reason.otherwise("default").alias("decided_by")
    )
