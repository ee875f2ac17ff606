"""Addresses as Column expressions: hosts, dedup keys, ids and guards."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from .text import Text, _c


def host(url: Text) -> Column:
    """Lower-cased host without www. and port; empty where there is none."""
    h = F.lower(F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(h, r"^www\.", "")


def path(url: Text) -> Column:
    return F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def dedup_key(url: Text, tracking: str = L.TRACKING_PARAMETER) -> Column:
    """Host without www., path without its last slash, and query without tracking parameters and blank values."""
    query = F.regexp_extract(_c(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: p.rlike("^[^=]*=.+") & ~F.regexp_extract(p, "^([^=]*)", 1).rlike(tracking))
    base = F.concat(host(url), F.regexp_replace(path(url), "/+$", ""))
    return F.when(F.size(kept) > 0, F.concat(base, F.lit("?"), F.array_join(kept, "&"))).otherwise(base)


def matches_domain(h: Column, domain: Column | str) -> Column:
    """equal to the domain or one of its subdomains."""
    d = F.lit(domain) if isinstance(domain, str) else domain
    return (h == d) | h.endswith(F.concat(F.lit("."), d))


def matches_any(h: Column, domains: Column | Iterable[str]) -> Column:
    """matches_domain() for one of several."""
    if isinstance(domains, Column):
        return F.exists(domains, lambda d: matches_domain(h, d))
    out = F.lit(False)
    for d in domains:
        out = out | matches_domain(h, d)
    return out


def positive_gate(url: Text, domains: Column, brand_tokens: Column) -> Column:
    """the host is in one of the domains, or holds a brand token."""
    h = host(url)
    return matches_any(h, domains) | F.exists(brand_tokens, lambda t: (F.length(t) >= 2) & h.contains(t))


def depth(url: Text) -> Column:
    """Number of path segments."""
    return F.size(F.filter(F.split(path(url), "/"), lambda s: s != ""))


def fast_path(url: Text, domains: Column, product_tokens: Column) -> Column:
    """confidence of an address that can be taken at sight: product token in the path 0.95, front page 0.9, else null."""
    mine, p = matches_any(host(url), domains), F.lower(path(url))
    return F.when(mine & F.exists(product_tokens, lambda t: p.contains(t)), 0.95).when(mine & (depth(url) <= 1), 0.9)


def video_id(url: Text) -> Column:
    """Id of a video address, else empty."""
    return F.regexp_extract(_c(url), r"(?:[?&]v=|youtu\.be/|/shorts/|/embed/)([A-Za-z0-9_-]{11})", 1)


_PLATFORM_HOSTS = {"youtube_official": "youtube.com", "instagram": "instagram.com", "x": "x.com", "blog_naver": "blog.naver.com", "blog_tistory": "tistory.com"}


def platform_allowed(url: Text, platform: Text) -> Column:
    """the host belongs to the platform; a self-hosted blog must be on none of them."""
    h, p = host(url), _c(platform)
    out = F.when(p == "blog_self_hosted", ~matches_any(h, _PLATFORM_HOSTS.values()) & (h != ""))
    for name, d in _PLATFORM_HOSTS.items():
        out = out.when(p == name, matches_any(h, [d, "twitter.com"] if name == "x" else [d]))
    return out.otherwise(h != "")


def handle(url: Text, platform: Text) -> Column:
    """Account named by an address."""
    p, rest = _c(platform), F.regexp_replace(path(url), "^/+", "")
    first = F.regexp_replace(F.split_part(rest, F.lit("/"), F.lit(1)), "^@", "")
    sub = F.regexp_extract(host(url), r"^([^.]+)\.tistory\.com$", 1)
    channel = F.regexp_extract(rest, "^(?:channel|c|user)/([^/]+)", 1)
    return F.when(p == "blog_tistory", sub).when(p == "youtube_official", F.when(channel != "", channel).otherwise(first)).otherwise(first)


def slug_title(url: Text) -> Column:
    """Last path segment, percent-decoded, dashes as spaces; plus signs stay."""
    last = F.element_at(F.split(F.regexp_replace(path(url), "/+$", ""), "/"), -1)
    return F.trim(F.regexp_replace(F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), last), "[-_]+", " "))


def mobile_rewrite(url: Text, hosts: dict[str, str]) -> Column:
    """Address with the given hosts exchanged for their mobile ones."""
    c = _c(url)
    for a, b in hosts.items():
        c = F.regexp_replace(c, f"://(?:www\\.)?{a.replace('.', chr(92) + '.')}(?=[/?#]|$)", f"://{b}")
    return c


def feed_candidates(url: Text, platform: Text, account: Text) -> Column:
    """Addresses where a blog's feed may be."""
    base, p, a = F.regexp_replace(_c(url), "/+$", ""), _c(platform), _c(account)
    return (
        F.when(p == "blog_naver", F.array(F.concat(F.lit("https://rss.blog.naver.com/"), a, F.lit(".xml"))))
        .when(p == "blog_tistory", F.array(F.concat(base, F.lit("/rss"))))
        .otherwise(F.array(*[F.concat(base, F.lit(x)) for x in ("/feed", "/rss", "/rss.xml", "/atom.xml")]))
    )


def handle_candidates(found: Column, most: int = 4) -> Column:
    """Handles worth probing: as found, then without separators, in order and without repeats."""
    bare = F.transform(found, lambda h: F.regexp_replace(F.lower(h), "[^a-z0-9]", ""))
    return F.slice(F.array_distinct(F.filter(F.concat(found, bare), lambda h: h != "")), 1, most)


def status_ok(status: Column) -> Column:
    """F38."""
    return F.coalesce(status.between(200, 399), F.lit(False))


def meta(html: Text) -> Column:
    """Title, description, canonical address and a 200-character snippet, by patterns."""
    c = _c(html)
    text = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>", " "), "<[^>]+>", " "), r"\s+", " "))
    return F.struct(
        F.trim(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"),
        F.regexp_extract(c, r"(?is)<meta[^>]+name=[\"']description[\"'][^>]+content=[\"']([^\"']*)", 1).alias("description"),
        F.regexp_extract(c, r"(?is)<link[^>]+rel=[\"']canonical[\"'][^>]+href=[\"']([^\"']*)", 1).alias("canonical"),
        F.substring(text, 1, 200).alias("snippet"),
    )


def links(html: Text) -> Column:
    """Addresses of the anchors of a page."""
    return F.array_distinct(F.regexp_extract_all(_c(html), F.lit(r"(?i)<a\b[^>]*\bhref=[\"']([^\"'#]+)"), 1))
