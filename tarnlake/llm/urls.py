"""URL filters whose decisions reach the aliases of a page."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import connected_components, cut

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A verdict (allow or block) for a host with its subdomains, and the paths that start with `path`."""

    verdict: str
    host: str
    path: str = "/"

    def __str__(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ?, # or end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits, null where none does; among rules of one length the first in the list wins.

    The rules are part of the plan, so this is for lists of up to a few hundred rules.
    """
    ranked = sorted(rules, key=lambda r: -len(str(r)))
    fits = lambda r: ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
    text = F.coalesce(F.lit(None).cast("string"), *(F.when(fits(r), F.lit(str(r))) for r in ranked))
    verdict = F.coalesce(F.lit(None).cast("string"), *(F.when(fits(r), F.lit(r.verdict)) for r in ranked))
    return text, verdict


def declared_target(html: Column) -> Column:
    """The absolute address that a page names as canonical or redirects to by a refresh, else null."""
    tag = F.regexp_extract(html, r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", 0)
    canonical = F.regexp_extract(tag, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    refresh = F.regexp_extract(html, r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*\bcontent\s*=\s*[\"']?\s*[0-9.]*\s*;\s*url\s*=\s*['\"]?([^\"'\s>]+)", 1)
    absolute = lambda c: F.when(c.rlike(r"(?i)\Ahttps?://"), c)
    return F.when(html.contains("<"), F.coalesce(absolute(canonical), absolute(refresh)))


def plain_form(url: Column) -> Column:
    """The address that servers commonly redirect to: https, no www., no default port, no fragment, no campaign parameters, no last slash."""
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"#.*\z", ""), r"(?i)([?&])(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*", "$1"), r"[?&]+\z", "")
    query = F.regexp_extract(clean, r"(?s)\A[^?]*(\?.*)?\z", 1)
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(?:80|443)\z", ""), r"\Awww\.", "")
    return F.when(host != "", F.concat(F.lit("https://"), host, F.regexp_replace(path_of(url), r"/+\z", ""), query))


def redirect_edges(pages: DataFrame) -> DataFrame:
    """(src, dst): addresses that name one page, as the page declares it and by the redirects that plain_form() follows."""
    url = F.col("url")
    to = F.explode(F.array(plain_form(url), declared_target(F.col("html")), plain_form(declared_target(F.col("html")))))
    return pages.where("url IS NOT NULL").select(url.alias("src"), to.alias("dst")).where("dst IS NOT NULL AND src <> dst").distinct()


def judge(pages: DataFrame, rules: list[Rule], edges: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of `pages`.

    A page with a rule has that rule's verdict. Others take part in their group of aliases (connected by `edges`, by default
    redirect_edges()): it is blocked if a rule blocks an address of the group and no rule allows one, else allowed. Null and
    malformed addresses have empty host and path, no rule, and are allowed; repeated rows are each judged; columns beyond
    page_id, url and html are not read.
    """
    edges = cut(redirect_edges(pages) if edges is None else edges.select("src", "dst"))
    host, path, url = host_of(F.col("url")), path_of(F.col("url")), F.col("url")
    text, verdict = best_rule(host, path, rules)
    judged = pages.select("page_id", "url", host.alias("host"), path.alias("path"), text.alias("rule"), verdict.alias("own"))
    member = cut(connected_components(edges))
    node_rule = best_rule(host_of(F.col("node")), path_of(F.col("node")), rules)[1]
    groups = member.select("component", node_rule.alias("own")).where("own IS NOT NULL").groupBy("component").agg((F.max("own") == "block").alias("has_block"), (F.min("own") == "allow").alias("has_allow"))
    blocked = groups.where("has_block AND NOT has_allow").select("component")
    aliases = cut(member.join(blocked, "component", "left_semi").select(F.col("node").alias("url"), F.lit("block").alias("spread")))
    if aliases.isEmpty():
        return judged.select("page_id", "host", "path", "rule", F.coalesce("own", F.lit("allow")).alias("verdict"))
    return judged.join(aliases, "url", "left").select("page_id", "host", "path", "rule", F.coalesce("own", "spread", F.lit("allow")).alias("verdict"))
