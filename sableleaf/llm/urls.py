"""URL filters with redirect equivalence (DataFrame operations only)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .components import connected_components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A rule for a host, all its subdomains, and paths that start with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rest_of(url: Column) -> Column:
    """What follows the first `://`; empty for null and for urls without it."""
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """Up to `/`, `?`, `#` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(rest_of(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1)


def fitting(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds to rows with host and path the text and verdict of the longest rule that fits (`rule`, `says`), else null.

    Rules are gathered by host, and hosts by their number of labels; a url's last
    so many labels are joined to those, once for each number, so a long list of
    rules costs as many joins as a short one, and Spark broadcasts it only if it
    is small. Of rules with the same text the allow wins.
    """
    spark = urls.sparkSession
    out, best = urls, []
    depths = sorted({r.host.count(".") + 1 for r in rules})
    for k in depths:
        own = [(r.host, r.path, r.text, r.verdict) for r in rules if r.host.count(".") + 1 == k]
        own = spark.createDataFrame(own, "__host string, path string, text string, verdict string")
        # by code points, the longest first; "allow" sorts before "block"
        own = own.groupBy("__host").agg(F.array_sort(F.collect_list(F.struct((-F.char_length("text")).alias("short"), "verdict", "path", "text"))).alias(f"__r{k}"))
        own = own.withColumnRenamed("__host", f"__h{k}")
        last = F.substring_index(F.col("host"), ".", -k)
        out = out.join(own, last == F.col(f"__h{k}"), "left")
        fits = F.filter(F.col(f"__r{k}"), lambda r: F.col("path").startswith(r["path"]))
        best.append(F.get(fits, F.lit(0)))
    if not rules:
        return out.withColumns({"rule": F.lit(None).cast("string"), "says": F.lit(None).cast("string")})
    top = F.least(*best) if len(best) > 1 else best[0]
    return out.withColumn("__top", top).withColumns({"rule": F.col("__top")["text"], "says": F.col("__top")["verdict"]}).drop("__top", *(f"__{x}{k}" for k in depths for x in "hr"))


def declared_target(html: Column) -> list[Column]:
    """Targets that a page declares: its canonical link and its meta refresh; empty if none."""
    link = F.regexp_extract(html, r"""(?is)<link\s[^>]*rel\s*=\s*["']?canonical[^>]*>""", 0)
    meta = F.regexp_extract(html, r"""(?is)<meta\s[^>]*http-equiv\s*=\s*["']?refresh[^>]*>""", 0)
    return [F.regexp_extract(link, r"""(?i)href\s*=\s*["']?([^"'\s>]+)""", 1), F.regexp_extract(meta, r"""(?i)url\s*=\s*["']?([^"'\s>;]+)""", 1)]


def resolved(target: Column, host: Column, path: Column) -> Column:
    """A target seen from a page, as a full url (the scheme doesn't matter here)."""
    folder = F.regexp_replace(path, r"[^/]*$", "")
    return (
        F.when(target == "", F.lit(None))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(F.lit("http://"), host, target))
        .otherwise(F.concat(F.lit("http://"), host, F.when(folder == "", "/").otherwise(folder), target))
    )


def filter_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html", redirects: DataFrame | None = None) -> DataFrame:
    """Judge every url: (page_id, host, path, rule, verdict, alias_block, alias_allow).

    A rule that fits the url itself decides. Else the aliases do: urls tied by
    redirects (`redirects`: from_url, to_url) or by what pages declare (canonical
    link, meta refresh) form components, and a component with an explicitly
    blocked url is blocked, unless one of its urls is explicitly allowed; without
    either the url is allowed. A url stands for its host and path; scheme, query
    and fragment don't count. Aliases needn't be pages themselves.

    Null urls and urls without `://` have empty host and path, fit no rule and
    take no part in links. Ids pass through unread, rows that repeat are judged
    alike, an empty table gives an empty one; other columns are ignored.
    """
    url = F.col(url_col).cast("string")
    own = pages.select(F.col(id_col).alias("page_id"), F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"), *(t.alias(f"t{k}") for k, t in enumerate(declared_target(F.col(html_col)) if html_col else [])))
    judged = fitting(own, rules).withColumnRenamed("says", "own").withColumn("node", F.when(F.col("host") != "", F.concat("host", "path")))
    ends = [c for c in own.columns if c.startswith("t") and c[1:].isdigit()]

    edges = None
    if ends:
        far = F.explode(F.array(*(resolved(F.col(c), F.col("host"), F.col("path")) for c in ends)))
        edges = judged.where(" or ".join(f"{c} <> ''" for c in ends)).select("host", "path", far.alias("far")).where("far is not null")
        edges = edges.select("host", "path", host_of(F.col("far")).alias("host2"), path_of(F.col("far")).alias("path2"))
    if redirects is not None:
        a, b = F.col("from_url"), F.col("to_url")
        more = redirects.select(host_of(a).alias("host"), path_of(a).alias("path"), host_of(b).alias("host2"), path_of(b).alias("path2"))
        edges = more if edges is None else edges.unionByName(more)
    out = judged.select("page_id", "host", "path", "rule", "own", "node")
    if edges is not None:
        edges = staged(edges.where("host <> '' and host2 <> ''").distinct(), "url_edges")
        if edges.isEmpty():
            edges = None
    if edges is None:
        return out.select("page_id", "host", "path", "rule", F.coalesce("own", F.lit("allow")).alias("verdict"), F.lit(False).alias("alias_block"), F.lit(False).alias("alias_allow"))
    nodes = edges.select("host", "path").unionByName(edges.select(F.col("host2").alias("host"), F.col("path2").alias("path"))).distinct()
    said = fitting(nodes, rules).select(F.concat("host", "path").alias("node"), "says")
    comps = staged(connected_components(edges.select(F.concat("host", "path").alias("a"), F.concat("host2", "path2").alias("b"))), "url_components")
    of = comps.join(said, "node").groupBy("component").agg(F.bool_or(F.col("says").eqNullSafe("block")).alias("alias_block"), F.bool_or(F.col("says").eqNullSafe("allow")).alias("alias_allow"))
    by_node = staged(comps.join(of, "component").select("node", "alias_block", "alias_allow").where("alias_block or alias_allow"), "url_verdicts")
    out = out.join(by_node, "node", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("alias_block", "alias_allow")})
    last = F.coalesce("own", F.when(F.col("alias_block") & ~F.col("alias_allow"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", last.alias("verdict"), "alias_block", "alias_allow")
