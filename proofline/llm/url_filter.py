"""URL verdicts by rules, spread over aliases: redirects and canonical links.

A url's own rule, the longest that fits its host and path, decides its verdict.
Urls without a rule take the verdict of their aliases: urls linked by
redirects, canonical links and the usual normal form (scheme, ``www.`` or
``m.``, fragment, tracking parameters and a trailing slash do not matter). Urls of one
normal form are aliases by that expression alone; aliases beyond that are the connected
components over links between different forms. An alias that is explicitly
allowed makes its component allowed, else one that is blocked makes it
blocked, else it is allowed.

Built-in functions only. The rules are a short list on the driver.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.llm.common import stored
from proofline.llm.components import components


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(at > 0, host).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty if there is no host part."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The text of the longest rule that fits, null if none; of equals an allowing one."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.verdict == "allow", r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(r.text)).otherwise(out)
    return out


def verdict_of(rule: Column, rules: list[Rule]) -> Column:
    """Of the rule with this text; where two say different things, allow."""
    allowed = [r.text for r in rules if r.verdict == "allow"]
    return F.when(rule.isin(allowed), "allow").when(rule.isNotNull(), "block")


def normal_form(url: Column) -> Column:
    """Without scheme, www. or m., fragment, tracking parameters and a trailing slash."""
    query = F.regexp_extract(url, r"^[^#?]*\?([^#]*)", 1)
    kept = F.array_join(
        F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)")), "&"
    )
    bare = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    return F.concat(F.lit("//"), bare, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def _attribute(tag: Column, name: str) -> Column:
    raw = F.regexp_extract(tag, rf"""(?i)\b{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.regexp_replace(F.trim(F.regexp_replace(raw, "^[\"']|[\"']$", "")), "&amp;", "&")


def _without_dots(path: Column) -> Column:
    """A path without its ``.`` and ``..`` segments."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)

    def step(done: Column, p: Column) -> Column:
        up = F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
        return F.when(p == ".", done).when(p == "..", up).otherwise(F.concat(done, F.array(p)))

    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array(F.lit("")), step)
    # Dots at the end name a folder.
    return F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))


def resolved(base: Column, link: Column) -> Column:
    """``link`` as found on the page ``base``: itself if it has a scheme, else resolved
    against ``base`` as in RFC 3986. Null where ``base`` has no ``://``, and for other
    schemes, such as ``mailto:``."""
    link = F.trim(link)
    scheme = F.regexp_extract(base, r"^([^:/?#]+):", 1)
    root = F.regexp_extract(base, r"^[^:/?#]+://[^/?#]*", 0)
    path = path_of(base)
    query = F.regexp_extract(base, r"^[^#?]*(\?[^#]*)", 1)
    own = F.regexp_extract(link, r"^[^?#]*", 0)
    rest = F.regexp_extract(link, r"^[^?#]*(.*)$", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, r"^(.*/)", 1))
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when((root == "") | link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(own.startswith("/"), F.concat(root, _without_dots(own), rest))
        .when(own != "", F.concat(root, _without_dots(F.concat(folder, own)), rest))
        .when(link.startswith("?"), F.concat(root, path, link))
        .when(link != "", F.concat(root, path, query, link))
    )


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(u, v): a page's url and the url its canonical link or refresh names, made absolute."""
    low = F.lower(F.col(html))
    told = pages.where(low.contains("canonical") | low.contains("http-equiv"))
    tags = told.select(
        F.col(url).alias("u"),
        F.explode(F.regexp_extract_all(F.col(html), F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), F.lit(0))).alias("tag"),
    )
    goes = F.when(
        (F.lower(F.substring("tag", 1, 5)) == "<link") & F.lower(_attribute(F.col("tag"), "rel")).rlike(r"(^|\s)canonical(\s|$)"),
        _attribute(F.col("tag"), "href"),
    ).when(
        F.lower(_attribute(F.col("tag"), "http-equiv")) == "refresh",
        F.regexp_extract(_attribute(F.col("tag"), "content"), r"(?i)url\s*=\s*['\"]?([^'\"]+)", 1),
    )
    links = tags.select("u", goes.alias("link")).where("link <> ''")
    return links.select("u", resolved(F.col("u"), F.col("link")).alias("v")).where(F.instr("v", "://") > 0)


def told_links(pages: DataFrame, url: str = "url", html: str | None = "html", redirects: DataFrame | None = None) -> DataFrame | None:
    """(u, v): urls that a redirect, a canonical link or a refresh says are one.

    ``redirects`` has columns ``source`` and ``target``, e.g. from a crawl log.
    """
    links = redirects.select(F.col("source").alias("u"), F.col("target").alias("v")) if redirects is not None else None
    if html:
        own = page_links(pages, url, html)
        links = own if links is None else links.unionByName(own)
    return None if links is None else stored(links.dropna().distinct(), "links")


def form_verdicts(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """(form, allowed, blocked): what the rules say of the urls (column ``url``) of each
    normal form, and of the form itself; forms without a rule are left out."""
    form = normal_form(F.col("url"))
    # A form has no scheme but the same host and path.
    as_url = F.concat(F.lit("x:"), F.col("form"))
    said = urls.where(F.instr("url", "://") > 0).select("url", form.alias("form")).select(
        "form",
        F.explode(
            F.array(
                verdict_of(matching_rule(host_of(F.col("url")), path_of(F.col("url")), rules), rules),
                verdict_of(matching_rule(host_of(as_url), path_of(as_url), rules), rules),
            )
        ).alias("verdict"),
    )
    return said.where("verdict is not null").groupBy("form").agg(
        F.max(F.col("verdict") == "allow").alias("allowed"), F.max(F.col("verdict") == "block").alias("blocked")
    )


def url_verdicts(
    pages: DataFrame,
    rules: list[Rule],
    id: str = "page_id",
    url: str = "url",
    html: str | None = "html",
    redirects: DataFrame | None = None,
) -> DataFrame:
    """A row per page: id, host, path, rule, verdict.

    A null url, or one without ``://``, has no host, path, rule or alias and is
    allowed. Repeated rows and ids are judged one by one. Only the named columns
    are read.
    """
    wanted = [F.col(id).alias("id"), F.col(url).alias("url")]
    pages = pages.select(*wanted, *([F.col(html).alias("html")] if html else []))
    urls = pages.select("url")
    links = told_links(pages, "url", "html" if html else None, redirects)
    edges = None
    if links is not None:
        urls = urls.unionByName(links.select(F.col("u").alias("url"))).unionByName(links.select(F.col("v").alias("url")))
        both = links.where((F.instr("u", "://") > 0) & (F.instr("v", "://") > 0))
        edges = both.select(normal_form(F.col("u")).alias("u"), normal_form(F.col("v")).alias("v")).where("u <> v")
    # Urls of one normal form are aliases by an expression; only links between different
    # forms need components, and without any there is no round.
    groups = stored(components(edges), "aliases") if edges is not None and not edges.isEmpty() else None
    said = form_verdicts(urls, rules)
    if groups is not None:
        said = said.join(groups.withColumnRenamed("node", "form"), "form", "left")
        said = said.groupBy(F.coalesce("component", "form").alias("form")).agg(
            F.max("allowed").alias("allowed"), F.max("blocked").alias("blocked")
        )
    blocked = said.where("blocked and not allowed").select(F.col("form").alias("alias"), F.lit(True).alias("by_alias"))
    judged = pages.select(
        "id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    ).withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    ruled = judged.where("rule is not null").withColumn("verdict", verdict_of(F.col("rule"), rules))
    others = judged.where("rule is null")
    others = others.withColumn("alias", F.when(F.instr("url", "://") > 0, normal_form(F.col("url"))))
    if groups is not None:
        others = others.join(groups.withColumnRenamed("node", "alias"), "alias", "left").withColumn(
            "alias", F.coalesce("component", "alias")
        )
    others = others.join(blocked, "alias", "left").withColumn("verdict", F.when(F.col("by_alias"), "block").otherwise("allow"))
    columns = [F.col("id").alias(id), "host", "path", "rule", "verdict"]
    return ruled.select(*columns).unionByName(others.select(*columns))
