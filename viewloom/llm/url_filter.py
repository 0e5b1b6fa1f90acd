"""URL filter with redirect equivalence.

Rules block or allow a host, its subdomains and a path prefix. Pages that redirect to each
other, or name each other as canonical, are aliases: a page without a rule of its own takes
the decision of its aliases, and an explicit allow among them outweighs any block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from viewloom.llm.common import ascii_lower
from viewloom.llm.components import components
from viewloom.operators.skew import lookup
from viewloom.operators.staging import stored

#: (verdict, host, path): a host covers its subdomains, a path all paths that start with it.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

_LINK = r"(?is)<link\b[^>]*>"
_CANONICAL = r"""(?is)\brel\s*=\s*("([^"]*\s)?canonical(\s[^"]*)?"|'([^']*\s)?canonical(\s[^']*)?'|canonical([\s/>]|$))"""
_HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
_META = r"(?is)<meta\b[^>]*>"
_REFRESH = r"""(?is)\bhttp-equiv\s*=\s*["']?refresh\b"""
_TARGET = r"""(?is)\bcontent\s*=\s*["']?[^"'>]*?\burl\s*=\s*["']?([^"'\s>]+)"""

# The entities that stand in addresses; & comes last, so that nothing is decoded twice.
_ENTITIES = {"&quot;": '"', "&#34;": '"', "&apos;": "'", "&#39;": "'", "&lt;": "<", "&gt;": ">", "&#47;": "/", "&#38;": "&", "&amp;": "&"}


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def _rest(url: Column) -> Column:
    """What follows the first ://, or null."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """From the first :// up to / ? # or the end, A-Z in lower case; empty if there is none."""
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"(?s)^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; empty if there is none."""
    return F.coalesce(F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _without_dots(path: Column) -> Column:
    """A path without its . and .. segments (RFC 3986, 5.2.4)."""

    def step(before: Column, segment: Column) -> Column:
        up = F.regexp_replace(before, r"(?s)/[^/]*$", "")
        return F.when(segment == "..", up).when(segment == ".", before).otherwise(F.concat(before, F.lit("/"), segment))

    segments = F.split(path, "/")
    walked = F.aggregate(F.slice(segments, F.lit(2), F.size(segments)), F.lit(""), step)
    open_end = F.element_at(segments, -1).isin(".", "..")
    return F.when(F.contains(path, F.lit("/.")), F.concat(walked, F.when(open_end, "/").otherwise(""))).otherwise(path)


def address(url: Column) -> Column:
    """What spellings of one address share: scheme and host in lower case, no dot segments, no fragment.

    Null if there is no ://.
    """

    def joined(plain: Column) -> Column:
        return _let(
            F.regexp_extract(plain, r"(?s)^(.*?://[^/?]*)", 1),
            lambda head: F.concat(
                ascii_lower(head),
                _let(
                    F.substring(plain, F.length(head) + 1, F.length(plain)),
                    lambda tail: _let(
                        F.regexp_extract(tail, r"(?s)^([^?]*)", 1),
                        lambda path: F.concat(
                            F.when(path == "", "/").otherwise(_without_dots(path)),
                            F.substring(tail, F.length(path) + 1, F.length(tail)),
                        ),
                    ),
                ),
            ),
        )

    return F.when(F.contains(url, F.lit("://")), _let(F.regexp_replace(url, r"(?s)#.*$", ""), joined))


def resolved(target: Column, page: Column) -> Column:
    """A link's target against the page it stands on (RFC 3986, 5.2), entities decoded.

    Null for a target without address of its own: empty, a fragment, or of a scheme without //.
    """
    to = target
    for entity, character in _ENTITIES.items():
        to = F.replace(to, F.lit(entity), F.lit(character))
    scheme = F.regexp_extract(page, r"(?s)^(.*?)://", 1)
    site = F.concat(scheme, F.lit("://"), host_of(page))
    folder = F.regexp_replace(path_of(page), r"(?s)[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    return _let(
        to,
        lambda t: F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), t)
        .when(t.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:|#|$)"), F.lit(None).cast("string"))
        .when(t.startswith("//"), F.concat(scheme, F.lit(":"), t))
        .when(t.startswith("/"), F.concat(site, t))
        .when(t.startswith("?"), F.concat(site, path_of(page), t))
        .otherwise(F.concat(site, folder, t)),
    )


def html_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): page and target of canonical links and of refresh redirects in the page's HTML.

    A target may be relative, and `canonical` any word of `rel`. Targets of other schemes, such as mailto, are left out.
    """
    tags = F.concat(
        F.transform(
            F.filter(F.regexp_extract_all(html, F.lit(_LINK), F.lit(0)), lambda t: t.rlike(_CANONICAL)),
            lambda t: F.regexp_extract(t, _HREF, 1),
        ),
        F.transform(
            F.filter(F.regexp_extract_all(html, F.lit(_META), F.lit(0)), lambda t: t.rlike(_REFRESH)),
            lambda t: F.regexp_extract(t, _TARGET, 1),
        ),
    )
    found = pages.where(F.col(html).isNotNull() & F.col(url).contains("://"))
    found = found.select(F.col(url).alias("_url"), F.explode(tags).alias("_to"))
    target = resolved(F.col("_to"), F.col("_url"))
    return found.select(address(F.col("_url")).alias("a"), address(target).alias("b")).where("b IS NOT NULL")


def _ruled(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Per distinct `_url` with a fitting rule: the longest rule and its verdict.

    A host is looked up with each of its suffixes, so the rules may be many. Of rules alike
    in host and path an allow wins.
    """
    parts = F.split(F.col("_host"), r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")
    )
    r = rules.select(F.col("host").alias("_rule_host"), F.col("path").alias("_rule_path"), F.col("verdict").alias("_verdict"))
    asked = urls.select("_url", "_path", F.explode(suffixes).alias("_suffix"))
    fits = (F.col("_suffix") == F.col("_rule_host")) & F.col("_path").startswith(F.col("_rule_path"))
    text = F.concat("_rule_host", "_rule_path")
    rank = F.struct(F.length(text).alias("size"), text.alias("rule"), (F.col("_verdict") == "allow").alias("allow"))
    best = asked.join(r, fits, "inner").groupBy("_url").agg(F.max(rank).alias("best"))
    return best.select("_url", F.col("best.rule").alias("rule"), F.col("best.allow").alias("allow"))


def judge(
    pages: DataFrame,
    rules: DataFrame | None = None,
    edges: DataFrame | None = None,
    id_column: str = "page_id",
    url: str = "url",
    html: str = "html",
    default: str = "allow",
) -> DataFrame:
    """Per row: id, host, path, rule, verdict and `via` (rule, alias or default).

    `edges` (columns a, b) are more redirects or canonical links between addresses, besides
    those in the pages' HTML; their ends need not be pages, and rules hold for them too. A page with a rule of its own follows it. Otherwise its
    class decides: allow if any member has an allow rule, block if any has a block rule,
    else `default`. A null url has empty host and path, no rule and no aliases. Rows keep
    their number; equal urls get equal verdicts.
    """
    rules = rule_table(pages.sparkSession) if rules is None else rules
    links = html_links(pages, url, html)
    if edges is not None:
        links = links.union(edges.select(address(F.col("a")), address(F.col("b"))))
    roots = components(links.distinct())

    rows = pages.select(F.col(id_column).alias("_id"), F.col(url).alias("_url"))
    urls = stored(rows.groupBy("_url").agg(F.count(F.lit(1)).alias("n_rows")).where("_url IS NOT NULL"))
    parts = urls.select("_url", host_of(F.col("_url")).alias("_host"), path_of(F.col("_url")).alias("_path"))
    own = stored(_ruled(parts, rules))
    at = urls.select("_url", address(F.col("_url")).alias("_at"))
    placed = at.join(roots, F.col("_at") == F.col("node"), "inner").select("_url", "root")
    ends = roots.select(F.col("node").alias("_url"), "root")  # also addresses that are no page
    ends = ends.join(_ruled(ends.select("_url", host_of(F.col("_url")).alias("_host"), path_of(F.col("_url")).alias("_path")), rules), "_url")
    said = placed.join(own, "_url").select("root", "allow").union(ends.select("root", "allow"))
    decided = stored(said.groupBy(F.col("root").alias("of")).agg(F.max("allow").alias("class_allow")))
    aliased = lookup(placed, decided, {"root": "of"}, "inner", spread=["_url"])
    aliased = aliased.select(F.col("_url").alias("_alias"), "class_allow")
    judged = stored(
        urls.select("_url").join(own, "_url", "left").join(aliased, F.col("_url") == F.col("_alias"), "left").select(
            F.col("_url").alias("_key"), "rule", F.coalesce("allow", "class_allow").alias("_allow"),
            F.when(F.col("allow").isNotNull(), "rule").when(F.col("class_allow").isNotNull(), "alias").alias("_via"),
        )
    )
    found = lookup(rows, judged, {"_url": "_key"}, "left", spread=["_id"], counts=urls)
    verdict = F.when(F.col("_allow"), "allow").when(~F.col("_allow"), "block").otherwise(default)
    return found.select(
        F.col("_id").alias(id_column), host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"),
        "rule", verdict.alias("verdict"), F.coalesce("_via", F.lit("default")).alias("via"),
    )
