"""URL filter with redirect equivalence, in DataFrame expressions only.

Rules are (verdict, host, path).  A rule fits its host and every subdomain of it when the
URL's path starts with the rule's path; the longest fitting rule (host and path together)
decides.  URLs without a fitting rule take the decision of their aliases: redirects
(``meta refresh``) and canonical links found in the pages are edges between URLs, and all
URLs of one connected component are aliases.  A component with a blocked URL blocks its
undecided members unless one member is explicitly allowed, since an explicit allow takes
precedence; everything else is allowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import lower_ascii

#: (verdict, host, path)
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url):
    return lower_ascii(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path_of(url):
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def node_of(url):
    """The graph node of a URL: host and the rest without scheme and fragment; null if it has
    no ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), rest))


def rule_of(host, path, rules=RULES):
    """Struct (verdict, rule) of the longest fitting rule, or null.  Of two rules of equal
    length the earlier in the table wins."""
    ranked = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    expr = None
    for verdict, rule_host, rule_path in ranked:
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) \
            & F.startswith(path, F.lit(rule_path))
        found = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule_host + rule_path).alias("rule"))
        expr = F.when(fits, found) if expr is None else expr.when(fits, found)
    return F.lit(None).cast("struct<verdict:string,rule:string>") if expr is None else expr


def alias_edges(pages: DataFrame) -> DataFrame:
    """``(u, v)`` nodes of each page's URL and of its canonical link or refresh target.

    Targets may be absolute, scheme-relative (``//host/..``) or root-relative (``/..``);
    others are ignored.  Null html or URL gives no edge.
    """
    tags = pages.select(
        F.col("url").cast("string").alias("url"),
        F.explode(F.regexp_extract_all(F.col("html").cast("string"), F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"), 1)).alias("tag"))
    canonical = F.when(F.rlike("tag", F.lit(r"(?is)^<link\b.*\brel\s*=\s*[\"']?canonical\b")),
                       F.regexp_extract("tag", r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    refresh = F.when(F.rlike("tag", F.lit(r"(?is)^<meta\b.*\bhttp-equiv\s*=\s*[\"']?refresh\b")),
                     F.regexp_extract("tag", r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1))
    target = F.coalesce(canonical, refresh)
    scheme = F.regexp_extract("url", r"(?s)^(.*?://)", 1)
    absolute = (F.when(F.instr(target, "://") > 0, target)
                .when(F.startswith(target, F.lit("//")), F.concat(F.lit("http:"), target))
                .when(F.startswith(target, F.lit("/")), F.concat(scheme, host_of(F.col("url")), target)))
    return (tags.select("url", absolute.alias("to")).where("to IS NOT NULL")
            .select(node_of(F.col("url")).alias("u"), node_of(F.col("to")).alias("v"))
            .where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct())


def decided_aliases(edges: DataFrame, rules=RULES) -> DataFrame:
    """``(node, blocked, allowed)``: what the rules say anywhere in the node's component."""
    members = connected_components(edges, "u", "v")
    url = F.concat(F.lit("x://"), F.col("node"))
    judged = members.withColumn("_r", rule_of(host_of(url), path_of(url), rules)["verdict"])
    per = judged.groupBy("component").agg(
        F.coalesce(F.bool_or(F.col("_r") == "block"), F.lit(False)).alias("blocked"),
        F.coalesce(F.bool_or(F.col("_r") == "allow"), F.lit(False)).alias("allowed"))
    return members.join(per, "component").select("node", "component", "blocked", "allowed")


def judge_urls(pages: DataFrame, rules=RULES, edges: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, component`` for every row of ``pages``.

    ``edges`` (columns ``u, v`` of nodes, see :func:`node_of`) adds redirect records to those
    found in the pages.  Null or malformed URLs have empty host and path, no rule and no
    aliases, and are allowed; repeated rows are each judged; an empty table gives an empty
    result; other columns are ignored.
    """
    found = alias_edges(pages)
    if edges is not None:
        found = found.union(edges.select("u", "v")).distinct()
    aliases = decided_aliases(found, rules)
    url = F.col("url").cast("string")
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"),
        node_of(url).alias("node")).withColumn("_own", rule_of(F.col("host"), F.col("path"), rules))
    by_alias = F.when(F.col("blocked") & ~F.col("allowed"), F.lit("block")).otherwise(F.lit("allow"))
    return own.join(aliases, "node", "left").select(
        "page_id", "host", "path", F.col("_own.rule").alias("rule"),
        F.coalesce(F.col("_own.verdict"), by_alias).alias("verdict"), "component")
