"""URL rules spread over redirect and canonical-link equivalence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, stage
from .components import connected_components

#: Tags whose attributes name another address: canonical links, refreshes and the base that relative addresses start from.
_TAGS = r"(?is)<(?:link|meta|base)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value, quoted or bare; empty where it isn't there."""
    found = lambda i: F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^"'\s>][^\s>]*))""", i)
    return F.concat(found(1), found(2), found(3))


def links_of(html: Column) -> Column:
    """struct(base, targets) of a page: the href of its first <base> (null if none), the href of each <link> with ``canonical`` among the words of its rel, and the address of each refresh."""
    tags = F.regexp_extract_all(html, F.lit(_TAGS), F.lit(0))
    kind = lambda t, name: t.rlike(rf"(?i)^<{name}\b")
    words = lambda t: F.split(F.lower(_attribute(t, "rel")), r"[\x20\x09-\x0D]+")
    canonicals = F.transform(F.filter(tags, lambda t: kind(t, "link") & F.array_contains(words(t), "canonical")), lambda t: _attribute(t, "href"))
    refreshes = F.transform(F.filter(tags, lambda t: kind(t, "meta") & (F.lower(_attribute(t, "http-equiv")) == "refresh")), lambda t: F.regexp_extract(_attribute(t, "content"), r"""(?is)\burl\s*=\s*["']?([^"']*)""", 1))
    bases = F.filter(F.transform(F.filter(tags, lambda t: kind(t, "base")), lambda t: _attribute(t, "href")), lambda h: h != "")
    return F.struct(F.get(bases, F.lit(0)).alias("base"), F.concat(canonicals, refreshes).alias("targets"))


def without_dots(path: Column) -> Column:
    """A path from the root with its . and .. segments resolved; what .. would take above the root stays at the root."""
    parts = F.slice(F.split(path, "/"), 2, F.size(F.split(path, "/")))  # behind the first slash
    up = lambda s: F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda s, x: F.when(x == "..", up(s)).when(x == ".", s).otherwise(F.concat(s, F.array(x))))
    ends = F.when(F.element_at(parts, -1).isin(".", ".."), F.when(F.size(kept) > 0, "/").otherwise("")).otherwise("")  # a last . or .. names a folder
    whole = F.concat(F.lit("/"), F.array_join(kept, "/"), ends)
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), whole).otherwise(path)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased. Path: then up to ? # or the end. Else empty."""
    rest = F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """The address that variants of a URL redirect to: no scheme, no www. or m., no fragment, no trackers, no final /."""
    host, path = host_and_path(url)
    query = F.regexp_extract(F.regexp_replace(url, r"(?s)#.*$", ""), r"(?s)\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[a-z]+|ref|fbclid|gclid)="))), "&")
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def matching_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule (like example.net/en/) whose host is the url's or a parent and whose path starts the url's."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):  # the longest is tried last, so it wins
        at, _, rest = rule.partition("/")
        of_host = (host == at) | host.endswith("." + at)
        out = F.when(of_host & path.startswith("/" + rest), F.lit(rule)).otherwise(out)
    return out


def _verdict(rule: Column, rules: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for name, verdict in rules.items():
        out = F.when(rule == name, F.lit(verdict)).otherwise(out)
    return out


def joined(url: Column, link: Column) -> Column:
    """The absolute address of a link on the page of a url, . and .. segments left as they are; null for other schemes than http(s) and empty links.

    A link without a scheme is completed with the scheme, host or folder of the page's url. Ports and user information stay part of the host.
    """
    link = F.regexp_replace(F.trim(link), "(?i)&amp;|&#38;|&#x26;", "&")
    scheme, host = F.regexp_extract(url, r"^(.*?)://", 1), F.regexp_extract(url, r"(?s)://([^/?#]*)", 1)
    root, path = F.concat(scheme, F.lit("://"), host), F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1)
    folder = F.when(path.contains("/"), F.regexp_replace(path, r"[^/]*$", "")).otherwise("/")
    return (
        F.when(link == "", F.lit(None).cast("string"))
        .when(link.rlike(r"^(?i)https?://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.rlike(r"^[?#]"), F.concat(root, path, link))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .otherwise(F.concat(root, folder, link))
    )


def tidied(address: Column) -> Column:
    """An absolute address with the . and .. segments of its path resolved."""
    part = lambda i: F.regexp_extract(address, r"(?s)^([^:]*://[^/?#]*)([^?#]*)(.*)$", i)
    return F.when(address.rlike(r"/\.\.?([/?#]|$)"), F.concat(part(1), without_dots(part(2)), part(3))).otherwise(address)


def resolve(url: Column, link: Column) -> Column:
    """The absolute address of a link on the page of a url, as browsers see it; null for other schemes than http(s) and empty links."""
    return tidied(joined(url, link))


def with_address(rows: DataFrame, name: str, url: str, link: str) -> DataFrame:
    """rows with ``name``, the link resolved against the url: a projection for each step, as one expression of all of them would repeat each many times."""
    return rows.withColumn("_joined", joined(F.col(url), F.col(link))).withColumn(name, tidied(F.col("_joined"))).drop("_joined")


def judge_urls(pages: DataFrame, rules: dict[str, str], redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages (page_id, url, html).

    rules: pattern -> "allow" or "block". A page that a rule fits has that rule's verdict, so an explicit allow stays
    whatever its aliases are. Any other page is blocked if a page or a link's target that a rule blocks is in its component, which redirects
    (source, target urls), canonical links, meta refreshes and variants of one address span; else it is allowed.
    A null url, or one without ://, has an empty host and path, no aliases, and is allowed. Repeated rows are judged alike.
    Links are resolved against the page's base, itself resolved against its url, or else against its url: whole, without a scheme, from the root, or from the folder.
    A page may have several; a rel may hold further words beside ``canonical``.
    """
    host, path = host_and_path(F.col("url"))
    address = F.when(F.col("url").contains("://"), canonical(F.col("url")))
    judged = pages.select("page_id", "url", "html", host.alias("host"), path.alias("path"), address.alias("node"))
    judged = judged.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    judged = judged.withColumn("own", _verdict(F.col("rule"), rules))
    marked = F.col("html").rlike(r"(?i)canonical|http-equiv")  # most pages have neither
    links = judged.filter(F.col("node").isNotNull() & marked).select("node", "url", links_of(F.col("html")).alias("of"))
    links = stage(links.select("node", "url", "of.base", F.explode("of.targets").alias("link")), "url-tags")
    # Written before nulls are left out: the optimizer would move that filter below, with all expressions in it.
    links = with_address(links, "from", "url", "base").withColumn("page", F.coalesce("from", "url"))
    links = stage(with_address(links.select("node", "page", "link"), "to", "page", "link").select("node", "to"), "url-targets").filter("to is not null").select(F.col("node").alias("a"), "to")
    if redirects is not None:
        links = links.union(redirects.select(canonical(F.col("source")).alias("a"), F.col("target").alias("to")))
    target = _verdict(matching_rule(*host_and_path(F.col("to")), rules), rules) == "block"
    links = stage(links.distinct().select("a", canonical(F.col("to")).alias("b"), F.coalesce(target, F.lit(False)).alias("bad")), "url-links")
    of_node = stage(connected_components(links).select("node", "component"), "url-components")
    # Blocked addresses, one row each: those of blocked pages and of blocked targets that aren't pages here, and all of their components.
    seeds = judged.filter("own = 'block' and node is not null").select("node").union(links.filter("bad").select("b")).distinct()
    bad = of_node.join(seeds, "node", "left_semi").select("component").distinct()
    blocked = stage(seeds.union(of_node.join(bad, "component", "left_semi").select("node")).distinct(), "url-blocked")
    few = blocked.count() <= BROADCAST_ROWS
    # Only pages without a rule look their address up, and pages without an address have none to look up.
    rows = judged.select("page_id", "host", "path", "rule", "own", "node")
    open_ = F.col("own").isNull() & F.col("node").isNotNull()
    looked = rows.filter(open_).join((F.broadcast(blocked) if few else blocked).withColumn("blocked", F.lit(True)), "node", "left")
    ruled = rows.filter(~open_).withColumn("blocked", F.lit(False))
    verdict = F.coalesce("own", F.when(F.col("blocked"), F.lit("block")), F.lit("allow"))
    return looked.unionByName(ruled).select("page_id", "host", "path", "rule", verdict.alias("verdict"))
