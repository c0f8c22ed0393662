"""URL filtering with redirect equivalence. DataFrame functions only.

Rules are (verdict, host, path prefix); one fits its host and all subdomains, and the longest that
fits wins. URLs that name the same thing are aliases: the same address but for scheme and fragment,
a page and the target of its canonical link or refresh redirect, and rows of an optional table
of redirects. Connected components over these edges carry block decisions to all aliases.

Precedence: a rule that fits an address itself decides it, allow and block alike; so an explicitly
allowed alias stays allowed though others of its component are blocked. An address without a rule is
blocked if any alias in its component, crawled or only linked to, is blocked by a rule, else allowed.

Defined cases: null URLs and those without "://" have an empty host and path and no aliases; repeated
rows are judged alike; an empty table gives an empty one; html may be null. Columns of the result that
the input has too (url_host and the like) are replaced; names that start with __url_ are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.operators.components import connected_components
from kindred.plans.stage import Stages

ADDED = ("url_host", "url_path", "url_rule", "url_verdict", "url_group")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def address_of(url: Column) -> Column:
    """Host, path and query: the URL without scheme and fragment; null for what has no host."""
    parts = F.regexp_extract_all(_rest(url), F.lit(r"^([^/?#]+)([^#]*)"), F.lit(0))
    whole = F.get(parts, 0)
    split = F.length(F.regexp_extract(whole, r"^[^/?#]*", 0))
    return F.concat(F.translate(whole.substr(F.lit(1), split), _UPPER, _LOWER), whole.substr(split + 1, F.length(whole)))


def declared_targets(pages: DataFrame) -> DataFrame:
    """(source, target) for pages (source, link, meta): one row for a canonical address, one for a refresh
    redirect. Targets are resolved against the page's address: absolute, of the same scheme ("//"), of the
    same host ("/"), the page with another query or fragment ("?", "#"), else beside the page; "." and
    ".." segments are folded."""
    canonical = F.regexp_extract("link", r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""", 1)
    refresh = F.regexp_extract("meta", r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)""", 1)
    both = pages.where("link <> '' or meta <> ''").select("source", F.explode(F.array_distinct(F.array(canonical, refresh))).alias("to")).where("to <> ''")
    host, path, to = F.coalesce(host_of(F.col("source")), F.lit("")), F.coalesce(path_of(F.col("source")), F.lit("")), F.col("to")
    beside = F.concat(F.lit("http://"), host, F.coalesce(F.nullif(F.regexp_extract(path, "^.*/", 0), F.lit("")), F.lit("/")), to)
    full = (
        F.when(to.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(to.startswith("//"), F.concat(F.lit("http:"), to))
        .when(to.startswith("/"), F.concat(F.lit("http://"), host, to))
        .when(to.rlike("^[?#]"), F.concat(F.lit("http://"), host, path, to))
        .when(~to.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), beside)
    )
    return both.select("source", _folded(full).alias("target"))


def _folded(url: Column) -> Column:
    """A URL whose path has no "." and ".." segments."""
    head, path = F.regexp_extract(url, r"^[^/]*//[^/?#]*", 0), F.regexp_extract(url, r"^[^/]*//[^/?#]*([^?#]*)", 1)
    rest = F.regexp_extract(url, r"[?#].*$", 0)
    parts = F.split(path, "/")
    step = lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))
    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.slice(parts, 1, 1), step)
    end = F.when(path.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.concat(head, F.array_join(kept, "/"), end, rest)).otherwise(url)


def tags_of(pages: DataFrame, url_col: str, html_col: str | None) -> DataFrame:
    """(source, link, meta): each page's canonical link and refresh tag, empty if it has none."""
    if html_col is None:
        return pages.select(F.col(url_col).alias("source"), F.lit("").alias("link"), F.lit("").alias("meta"))
    html = F.col(html_col)
    link = F.regexp_extract(html, r"""(?i)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>""", 0)
    meta = F.regexp_extract(html, r"""(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>""", 0)
    return pages.select(F.col(url_col).alias("source"), F.coalesce(link, F.lit("")).alias("link"), F.coalesce(meta, F.lit("")).alias("meta"))


def rule_for(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """(address, rule, rule_verdict) for the addresses that a rule fits.

    Every suffix of the host at a dot is a join key, so rules are found by an equi-join whatever their
    number, and only the few rules of one host are compared by path.
    """
    labels = F.split("host", r"\.")
    last = rules.agg(F.max(F.size(F.split("rule_host", r"\."))).alias("depth")).first()["depth"] or 1
    # Suffixes of no more labels than the longest rule has: a host of many dots gives no more keys.
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(last))), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    keyed = addresses.withColumn("rule_host", F.explode(suffixes))
    text = F.concat("rule_host", "rule_path")
    return (
        keyed.join(rules, "rule_host")
        .where(F.col("path").startswith(F.col("rule_path")))
        .groupBy("address")
        .agg(F.max(F.struct(F.length(text).alias("n"), (F.col("rule_verdict") == "allow").alias("a"), text.alias("rule"), "rule_verdict")).alias("best"))
        .select("address", "best.rule", "best.rule_verdict")
    )


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None, url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """The columns of ``pages`` with url_host, url_path, url_rule, url_verdict and url_group (the
    smallest address of its component; null without a host).

    ``redirects``: (source, target) URLs.
    """
    if any(c.startswith("__url_") for c in pages.columns):
        raise ValueError("column names that start with __url_ are reserved")
    stage = Stages()
    spark = pages.sparkSession
    table = spark.createDataFrame(rules, "rule_verdict string, rule_host string, rule_path string")
    # Written at once: later filters meet plain columns, not copies of the pattern matches.
    tags = stage(tags_of(pages, url_col, html_col).distinct(), "tags")
    moves = stage(declared_targets(tags), "moves").dropna()
    if redirects is not None:
        moves = moves.union(redirects.select("source", "target"))
    edges = stage(moves.select(address_of(F.col("source")).alias("id1"), address_of(F.col("target")).alias("id2")), "aliases")
    groups = connected_components(edges.dropna().distinct(), stages=stage).withColumnRenamed("id", "address")

    url = F.col("source")
    seen = stage(tags.select("source").distinct().select("source", address_of(url).alias("address"), host_of(url).alias("url_host"), path_of(url).alias("url_path")), "urls")
    whole = F.concat(F.lit("http://"), F.col("address"))
    linked = groups.select("address").join(seen.select("address").dropna().distinct(), "address", "left_anti")
    named = stage(seen.select("address", F.col("url_host").alias("host"), F.col("url_path").alias("path")).where("address is not null").distinct().union(linked.select("address", host_of(whole), path_of(whole))), "addresses")
    ruled = rule_for(named, table)
    blocked = groups.join(ruled, "address").groupBy("component_id").agg(F.max(F.col("rule_verdict") == "block").alias("blocked"))
    decided = named.select("address").join(ruled, "address", "left").join(groups, "address", "left").join(blocked, "component_id", "left")
    method = F.when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow")
    decided = decided.select("address", F.col("rule").alias("url_rule"), F.coalesce("rule_verdict", method).alias("url_verdict"), F.coalesce("component_id", "address").alias("url_group"))
    # One row a URL is written; the pages themselves are only joined to it.
    judged = stage.finish(seen.join(decided, "address", "left").drop("address").withColumnRenamed("source", "__url_source"), "judged")
    own = [f"`{c}`" for c in pages.columns if c not in ADDED]
    out = pages.select(*own, F.col(f"`{url_col}`").alias("__url_own")).join(judged, F.col("__url_own").eqNullSafe(F.col("__url_source")), "left")
    return out.select(*own, "url_host", "url_path", "url_rule", F.coalesce("url_verdict", F.lit("allow")).alias("url_verdict"), "url_group")
