"""URL filtering with rules and redirect equivalence.

Rules name a host and a path prefix. A page that a rule fits gets that rule's
verdict; the longest rule wins. Pages that no rule fits are judged by what they
are aliases of: redirects, canonical links and meta refreshes are edges between
URLs, connected components are found by distributed contraction, and a
component with a blocked member blocks its members, unless an allow rule holds
for the member itself, which always comes first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import staged

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def url_host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; '' for null or no ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; '' for null or no ``://``."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def url_key(url: Column) -> Column:
    """The node of a URL: its fragment never reaches a server, so it is left out, and the host has one case."""
    bare = F.regexp_extract(url, r"^[^#]*", 0)
    scheme = F.translate(F.substring_index(bare, "://", 1), _UPPER, _LOWER)
    rest = _after_scheme(bare)
    host = url_host(bare)
    return F.when(F.instr(bare, "://") > 0, F.concat(scheme, F.lit("://"), host, F.substring(rest, F.length(host) + 1, F.length(rest)))).otherwise(bare)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as struct(rule, verdict), null if none fits.

    ``rules`` are (verdict, host, path prefix). A rule fits its host and all
    subdomains, if the path starts with its prefix. Of equally long rules the
    one listed first wins.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, prefix in sorted(rules, key=lambda r: len(r[1] + r[2]), reverse=True)[::-1]:
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        found = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


#: Named entities that a URL may hold.
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
#: What a browser does not read as tags: comments, also one that is never closed, and elements of raw text.
_UNREAD = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title)\b.*?</\1\s*>"
#: A tag up to its end; quotes may hold the sign that ends it.
_TAG = r"(?i)<(?:link|meta|base)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
#: A name with its value, in double, single or no quotes.
_ATTRIBUTE = r"[^\s\"'<>/=]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?"
_VALUE = r"^[^\s=]+\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))$"


def _character(code: Column) -> Column:
    """The character of a code point; the replacement character where there is none."""
    high, low = F.lit(0xD800) + F.shiftright(code - 0x10000, 10), F.lit(0xDC00) + code.bitwiseAND(0x3FF)
    units = F.when(code < 0x10000, F.lpad(F.hex(code), 4, "0")).otherwise(F.concat(F.hex(high), F.hex(low)))
    good = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    return F.when(good, F.decode(F.unhex(units), "UTF-16BE")).otherwise(F.lit("\ufffd"))


def decoded(value: Column) -> Column:
    """``value`` with its named and numeric entities decoded, each once."""
    parts = F.regexp_extract_all(value, F.lit(r"&#[xX][0-9A-Fa-f]{1,6};?|&#[0-9]{1,7};?|&(?:%s);|[^&]+|&" % "|".join(_NAMED)), 0)
    named = F.create_map(*(F.lit(x) for name, sign in _NAMED.items() for x in (f"&{name};", sign)))

    def one(part: Column) -> Column:
        hexed = F.conv(F.regexp_extract(part, r"^&#[xX]([0-9A-Fa-f]+)", 1), 16, 10).cast("long")
        plain = F.regexp_extract(part, r"^&#([0-9]+)", 1).try_cast("long")
        numeric = F.when(part.rlike("^&#[xX]"), _character(hexed)).otherwise(_character(plain))
        return F.when(part.startswith("&#"), numeric).otherwise(F.coalesce(F.try_element_at(named, part), part))

    return F.array_join(F.transform(parts, one), "")


def _groups(value: Column, pattern: str) -> Column:
    """What the one of three groups matched that took part."""
    return F.concat(*(F.regexp_extract(value, pattern, i) for i in (1, 2, 3)))


def attribute(tag: Column, name: str) -> Column:
    """The decoded value of a tag's first attribute of that name; null if it has none."""
    body = F.regexp_replace(tag, r"^<[A-Za-z]+", " ")
    all_ = F.regexp_extract_all(body, F.lit(_ATTRIBUTE), 0)
    mine = F.filter(all_, lambda x: F.lower(F.regexp_extract(x, r"^[^\s=]+", 0)) == name)
    return _bound(F.try_element_at(mine, F.lit(1)), lambda x: decoded(_groups(x, _VALUE)))


def _without_dots(target: Column) -> Column:
    """A path, with what follows it, without its ``.`` and ``..`` parts."""
    path, rest = F.regexp_extract(target, r"^[^?#]*", 0), F.regexp_extract(target, r"^[^?#]*(.*)$", 1)
    parts = F.split(path, "/", -1)
    parts = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)

    def step(done: Column, part: Column) -> Column:
        back = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))
        return F.when(part == ".", done).when(part == "..", back).otherwise(F.concat(done, F.array(part)))

    return F.concat(F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"), rest)


def resolved(base: Column, target: Column) -> Column:
    """The URL that ``target`` means on the page ``base``: absolute, without scheme, without host or relative to the folder.

    Null where either is null, where the base has no ``://``, for an empty
    target or a mere fragment, and for schemes without ``://``.
    """
    return _bound(F.struct(base.alias("base"), target.alias("target")), lambda x: _resolved(x["base"], x["target"]))


def _resolved(base: Column, target: Column) -> Column:
    scheme, rest = F.substring_index(base, "://", 1), _after_scheme(base)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    folder = F.regexp_extract(path, r"^.*/", 0)
    root = F.concat(scheme, F.lit("://"), host)
    found = (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.when(F.instr(target, "://") > 0, target))
        .when(F.instr(base, "://") == 0, None)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(root, _without_dots(target)))
        .when(target.startswith("?"), F.concat(root, path, target))
        .when((target == "") | target.startswith("#"), None)
        .otherwise(F.concat(root, _without_dots(F.concat(F.when(folder == "", "/").otherwise(folder), target))))
    )
    return F.when(base.isNotNull(), found)


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Edges (a, b) that pages state themselves: every ``<link rel=canonical>`` and meta refresh.

    Comments and raw text such as scripts are cut first. Tags are taken apart by
    attribute, with their quotes, so neither a quoted ``>`` nor an attribute like
    ``data-href`` misleads. Targets are decoded and resolved against the page's
    first ``<base href>``, itself resolved, else against its URL. Pages with a
    null URL or null html state none.
    """
    tags = F.regexp_extract_all(F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), _UNREAD, " "), F.lit(_TAG), 0)
    rows = pages.select(F.col(url_col).alias("a"), tags.alias("tags")).where("a is not null and size(tags) > 0")
    is_base = lambda t: t.rlike("(?i)^<base")
    based = F.filter(F.transform(F.filter("tags", is_base), lambda t: attribute(t, "href")), lambda h: h.isNotNull())
    base = _bound(F.struct("a", F.trim(F.try_element_at(based, F.lit(1))).alias("stated")), lambda x: F.coalesce(resolved(x["a"], x["stated"]), x["a"]))
    # One row for each link; what the tag says is worked out once, in the lambda.
    targets = F.transform(F.filter("tags", lambda t: ~is_base(t)), _target)
    rows = rows.select("a", base.alias("base"), F.explode(F.filter(targets, lambda t: t.isNotNull())).alias("to"))
    rows = rows.select("a", resolved(F.col("base"), F.col("to")).alias("b")).where("b is not null")
    return rows.select(_bound(F.col("a"), url_key).alias("a"), _bound(F.col("b"), url_key).alias("b")).where("a <> b")


def _target(tag: Column) -> Column:
    """Where a canonical link or a refresh leads, as it is written; null for other tags."""
    words = F.split(F.lower(attribute(tag, "rel")), r"\s+")
    canonical = F.coalesce(F.array_contains(words, "canonical"), F.lit(False))
    refresh = F.coalesce(F.lower(F.trim(attribute(tag, "http-equiv"))) == "refresh", F.lit(False))
    later = r"(?is)^\s*[\d.]*\s*[;,\s]\s*(?:url\s*=\s*)?(?:\"([^\"]*)|'([^']*)|([^\s\"']\S*))"
    link = F.when(tag.rlike("(?i)^<link") & canonical, F.trim(attribute(tag, "href")))
    return F.when(tag.rlike("(?i)^<meta") & refresh, _bound(attribute(tag, "content"), lambda c: F.trim(_groups(c, later)))).otherwise(link)


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """Judge every page: (page_id, host, path, rule, verdict, alias_blocked).

    ``redirects`` has columns a and b with URLs; edges found in the html are
    added to it. A page without a fitting rule is blocked if a page or URL of
    its component is blocked by a rule, else allowed. Null URLs have empty host
    and path, fit no rule with a host, and are allowed. Repeated rows are judged
    alike; an empty table gives an empty result.
    """
    url = F.col("url")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    edges = page_links(pages, url_col, html_col) if html_col else None
    if redirects is not None:
        given = redirects.select(url_key(F.col("a")).alias("a"), url_key(F.col("b")).alias("b"))
        edges = given if edges is None else edges.unionByName(given)
    judged = rows.select("page_id", url_key(url).alias("key"), url_host(url).alias("host"), url_path(url).alias("path"))
    judged = judged.withColumn("hit", matching_rule(F.col("host"), F.col("path"), rules))
    if edges is None:
        spread = None
    else:
        members = staged(connected_components(edges), "aliases")
        # The rules are applied to all URLs of a component, crawled or not.
        verdict = matching_rule(url_host(F.col("node")), url_path(F.col("node")), rules)["verdict"]
        bad = members.groupBy("root").agg(F.max((F.coalesce(verdict, F.lit("")) == "block").cast("int")).alias("bad")).where("bad = 1")
        spread = staged(members.join(bad.select("root"), "root", "left_semi").select(F.col("node").alias("key"), F.lit(True).alias("alias")), "blocked-aliases")
    judged = judged.withColumn("alias", F.lit(False)) if spread is None else judged.join(spread, "key", "left")
    alias = F.coalesce("alias", F.lit(False))
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("hit")["rule"].alias("rule"),
        F.coalesce(F.col("hit")["verdict"], F.when(alias, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        alias.alias("alias_blocked"),
    )
