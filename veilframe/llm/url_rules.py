"""URL filters with redirect equivalence (operator 3), in DataFrame functions only.

Rules: a rule names a host and a path; it fits its host and all subdomains if the URL's path starts with its own. Of the
rules that fit, the one with the longest host and path decides (of equals an allowing one).

Method for URLs without a rule: URLs that redirect to one another, or name one another as canonical, are aliases. The
connected components over these edges are found by star contraction. A component with a blocked member, and none that a rule
explicitly allows, is blocked as a whole; other URLs are allowed.

Edges come from a table (from_url, to_url), or from the pages themselves: ``<link rel=canonical href=...>`` and ``<meta http-equiv=refresh
content=...url=...>``; a target without ``://`` is taken relative to the page's host (or, without leading slash, folder). Fragments don't tell URLs apart.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and has no aliases: allowed; rows that
repeat are each judged; edges with a null end are none; other columns of pages pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, every, fresh
from .graph import connected_components

#: Rules up to this number are compiled into one expression; more are joined.
COMPILED_RULES = 256

_ATTRIBUTE = r"""\s*=\s*["']?"""
CANONICAL = (
    rf"""(?is)<link\b(?=[^>]*\brel{_ATTRIBUTE}canonical\b)[^>]*\bhref{_ATTRIBUTE}([^"'\s>]+)""",
    rf"""(?is)<meta\b(?=[^>]*\bhttp-equiv{_ATTRIBUTE}refresh\b)[^>]*\burl\s*=\s*["']?([^"'\s>;]+)""",
)


class Rule(NamedTuple):
    host: str
    path: str
    action: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.coalesce(ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.lit(""))
    return host, F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _compiled(rules: list[Rule]) -> Column:
    """rule and action of the rule that decides over the columns host and path, or null."""
    decided = F.lit(None).cast("struct<rule:string,action:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.action == "allow")):
        fits = ((F.col("host") == rule.host) | F.endswith(F.col("host"), F.lit("." + rule.host))) & F.startswith(F.col("path"), F.lit(rule.path))
        decided = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.action).alias("action"))).otherwise(decided)
    return decided


def _by_join(located: DataFrame, rules: list[Rule]) -> DataFrame:
    table = located.sparkSession.createDataFrame([(r.host, r.path, r.name, r.action) for r in rules], "rule_host string, rule_path string, rule string, action string")
    labels = F.split("host", "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = located.select("url", "host", "path", F.explode(suffixes).alias("suffix")).join(table, F.col("suffix") == F.col("rule_host")).filter(F.startswith(F.col("path"), F.col("rule_path")))
    best = found.groupBy("url").agg(F.max_by(F.struct("rule", "action"), F.struct(F.length("rule"), F.col("action") == "allow")).alias("by"))
    return located.join(best, "url", "left").select("url", "host", "path", "by")


def match(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """url, host, path and by (rule and action of the rule that decides, or null) of each row of urls (url, different ones)."""
    if bad := [r for r in rules if r.action not in ("allow", "block") or not r.host]:
        raise ValueError(f"rules need a host and the action allow or block: {bad[:3]}")
    host, path = host_and_path(F.col("url"))
    located = urls.select("url", host.alias("host"), path.alias("path"))
    return located.withColumn("by", _compiled(rules)) if len(rules) <= COMPILED_RULES else _by_join(located, rules)


def _node(url: Column) -> Column:
    """What stands for a URL among the aliases: itself without the fragment; null if it has no host."""
    return F.when(F.instr(url, "://") > 0, F.substring_index(url, "#", 1))


def edges_of_pages(pages: DataFrame) -> DataFrame:
    """from_url and to_url of the redirects and canonical links in pages (url, html)."""
    url = F.col("from_url")
    found = [F.regexp_extract("html", pattern, 1) for pattern in CANONICAL]
    rows = pages.filter("html IS NOT NULL AND instr(url, '://') > 0").select(F.col("url").alias("from_url"), F.explode_outer(F.array(*found)).alias("to")).filter("to <> ''")
    root = F.regexp_extract(url, "^[^/?#]*//[^/?#]*", 0)
    scheme = F.substring_index(url, "//", 1)
    folder = F.regexp_replace(F.concat(root, host_and_path(url)[1]), "^([^/]*//[^/]*(?:/.*)?)/[^/]*$", "$1")
    to = F.col("to")
    whole = F.when(to.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), to).when(to.startswith("//"), F.concat(scheme, to)).when(to.startswith("/"), F.concat(root, to)).otherwise(F.concat(folder, F.lit("/"), to))
    return rows.select("from_url", whole.alias("to_url"))


def _decisions(edges: DataFrame, rules: list[Rule]) -> DataFrame:
    """node and decision (block) of each URL among the edges whose component is blocked."""
    pairs = edges.select(_node(F.col("from_url")).alias("u"), _node(F.col("to_url")).alias("v"))
    members = connected_components(pairs)
    judged = match(members.select(F.col("node").alias("url")), rules).select(F.col("url").alias("node"), F.col("by.action").alias("action"))
    judged = members.join(judged, "node")
    blocked = judged.groupBy("component").agg(F.max(F.col("action") == "block").alias("block"), F.max(F.col("action") == "allow").alias("allow"))
    blocked = blocked.filter("block AND NOT coalesce(allow, false)").select("component")
    return members.join(blocked, "component", "left_semi").select("node", F.lit("block").alias("decision"))


def judge(pages: DataFrame, rules: list[Rule], edges: DataFrame | None = None) -> DataFrame:
    """pages with host, path, rule and verdict (they replace columns of these names). edges: (from_url, to_url); those in the pages' html if not given."""
    added = ("host", "path", "rule", "verdict")
    decided = _decisions(edges_of_pages(pages) if edges is None else edges, rules)
    url, by, node, decision = (fresh(pages, name) for name in ("rule_url", "by", "node", "decision"))
    decided = decided.select(F.col("node").alias(node), F.col("decision").alias(decision))
    if len(rules) <= COMPILED_RULES:
        host, path = host_and_path(F.col("url"))
        rest = pages.select(*every(pages, added), host.alias("host"), path.alias("path")).withColumn(by, _compiled(rules))
    else:
        known = match(pages.select("url").filter("url IS NOT NULL").distinct(), rules)
        known = known.select(F.col("url").alias(url), "host", "path", F.col("by").alias(by))
        rest = pages.select(*every(pages, added)).join(known, F.col("url") == F.col(url), "left").withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    rest = rest.join(decided, _node(F.col("url")) == F.col(node), "left")
    verdict = F.coalesce(F.col(by)["action"], F.col(decision), F.lit("allow"))
    return rest.select(*every(pages, added), "host", "path", F.col(by)["rule"].alias("rule"), verdict.alias("verdict"))


def allowed(pages: DataFrame, rules: list[Rule], edges: DataFrame | None = None) -> DataFrame:
    """The rows of pages that are not blocked."""
    names = {name: fresh(pages, f"own_{name}") for name in ("host", "path", "rule", "verdict") if name in pages.columns}
    judged = judge(pages.withColumnsRenamed(names), rules, edges).filter("verdict = 'allow'").drop("host", "path", "rule", "verdict")
    return judged.withColumnsRenamed({b: a for a, b in names.items()}).select(*every(pages))
