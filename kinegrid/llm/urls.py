"""URL filters with redirect equivalence, in DataFrame functions only.

A url is judged by the longest rule that fits its host (or a parent domain) and the start of its path.
Redirects and canonical links make urls aliases of one another: distributed connected components over
these edges form classes, and a block decision on one member holds for all members without a rule of
their own, unless a member is explicitly allowed. A url's own rule always comes first; without
any decision the verdict is ``allow``.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule and has no
aliases; repeated pages are judged alike; null or unresolvable link targets make no edge; an empty table
gives no rows.
"""

from __future__ import annotations

import html.entities
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinegrid.llm.common import small_or_joined
from kinegrid.llm.components import connected_components

#: Up to so many rules are one CASE expression; beyond it they are a joined table keyed by host.
INLINE_RULES = 100
META_TAG = r"""(?is)(<meta\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>)"""
REFRESH_TAG = r"""(?is)[\s"'/]http-equiv\s*=\s*["']?\s*refresh\b"""
CONTENT = r"""(?is)[\s"'/]content\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
REFRESH_URL = r"""(?is)^\s*[\d.]*\s*[;,]?\s*url\s*=\s*["']?\s*([^"'\s]+)"""
SCHEME = "[A-Za-z][A-Za-z0-9+.-]*:"
REFERENCE = "(&#[0-9]{1,7};?|&#[xX][0-9a-fA-F]{1,6};?|&[A-Za-z]+;|&(?:amp|lt|gt|quot)(?![=A-Za-z0-9;])|[^&]+|&)"
#: Named references: the Latin and Greek ones, and those of ASCII characters.
NAMES = {k: chr(v) for k, v in html.entities.name2codepoint.items()} | {k[:-1]: v for k, v in html.entities.html5.items() if k.endswith(";") and v.isascii()}
LINK_TAG = r"""(?is)(<link\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>)"""
BASE_TAG = r"""(?is)(<base\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>)"""
CANONICAL = r"""(?is)[\s"'/]rel\s*=\s*(?:"(?:[^"]*\s)?canonical(?:\s[^"]*)?"|'(?:[^']*\s)?canonical(?:\s[^']*)?'|canonical(?=[\s/>]))"""
HREF = r"""(?is)[\s"'/]href\s*=\s*(?:"\s*([^"]*?)\s*"|'\s*([^']*?)\s*'|([^\s>"']+))"""


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path (up to ``?`` or ``#``), both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def alias_key(url: Column) -> Column:
    """What makes two spellings the same node: host, path and query, without scheme and fragment."""
    host, path = split_url(url)
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    return F.when(host == "", F.lit(None)).otherwise(F.concat(host, path, query))


def _fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    return ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)


def best_rule(df: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Adds ``rule`` (host and path) and ``rule_verdict``: of the longest rule that fits columns host and path."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0]))
    if len(ordered) <= INLINE_RULES:
        rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
        for kind, host, path in reversed(ordered):
            fits = _fits(F.col("host"), F.col("path"), host, path)
            rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
        return df.withColumns({"rule": rule, "rule_verdict": verdict})
    # One row per rule host with its rules, longest first. Each distinct host looks up its own
    # suffixes, so the join never sees a host's rows more than once per suffix.
    table = df.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(ordered)], "i long, kind string, rule_host string, rule_path string")
    labels = F.split(F.col("host"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    of_host = (
        df.select("host").distinct().select("host", F.explode(suffixes).alias("rule_host")).join(table, "rule_host")
        .groupBy("host").agg(F.sort_array(F.collect_list(F.struct("i", "kind", "rule_host", "rule_path"))).alias("host_rules"))
    )
    found = F.get(F.filter("host_rules", lambda r: F.col("path").startswith(r["rule_path"])), 0)
    return (
        df.join(of_host, "host", "left").withColumn("found", found)
        .withColumns({"rule": F.concat(F.col("found.rule_host"), F.col("found.rule_path")), "rule_verdict": F.col("found.kind")})
        .drop("host_rules", "found")
    )


def decoded(text: Column) -> Column:
    """Character references read; what is none stays as it is."""
    names = F.create_map(*(F.lit(x) for pair in NAMES.items() for x in pair))

    def read(x: Column) -> Column:
        name = F.regexp_extract(x, "^&([A-Za-z]+);?$", 1)
        digits, hexed = F.regexp_extract(x, "^&#([0-9]+)", 1), F.regexp_extract(x, "^&#[xX]([0-9a-fA-F]+)", 1)
        code = F.when(digits != "", digits.cast("long")).otherwise(F.conv(hexed, 16, 10).cast("long"))
        code = F.when((code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF), 0xFFFD).otherwise(code)
        number = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(x.startswith("&#") & (F.length(x) > 2), number).when(name != "", F.coalesce(F.try_element_at(names, name), x)).otherwise(x)

    parts = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1)), read)
    return F.when(text.contains("&"), F.array_join(parts, "")).otherwise(text)


def _without_dots(path: Column) -> Column:
    """A path that starts with a slash, its ``.`` and ``..`` segments resolved."""
    names = F.split(F.regexp_replace(path, r"/\.{1,2}$", "$0/"), "/")
    step = lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.concat(acc, F.array(x)))
    return F.when(path.contains("/."), F.array_join(F.aggregate(F.slice(names, 2, F.greatest(F.size(names), F.lit(1))), F.array(F.lit("")), step), "/")).otherwise(path)


def resolved(own: Column, to: Column) -> Column:
    """The url that a reference on page ``own`` names; null for other schemes than those with ``://``, and without a base."""
    origin = F.regexp_extract(own, f"^({SCHEME}//[^/?#]*)", 1)
    base = F.regexp_extract(own, f"(?s)^{SCHEME}//[^/?#]*([^?#]*)", 1)
    folder = F.concat(F.lit("/"), F.regexp_extract(base, "(?s)^/(.*/)", 1))
    path, rest = F.regexp_extract(to, "(?s)^([^?#]*)", 1), F.regexp_extract(to, "(?s)^[^?#]*(.*)$", 1)
    return (
        F.when(to.rlike(f"^{SCHEME}//"), to).when(to.rlike(f"^{SCHEME}") | (origin == ""), F.lit(None))
        .when(to.startswith("//"), F.concat(F.regexp_extract(own, f"^({SCHEME})", 1), to))
        .when(path == "", F.when(to.startswith("?"), F.concat(origin, base, to)))
        .when(to.startswith("/"), F.concat(origin, _without_dots(path), rest))
        .otherwise(F.concat(origin, _without_dots(F.concat(folder, path)), rest))
    )


def _attribute(tag: Column, pattern: str) -> Column:
    return F.concat(*(F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)))


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): alias keys of each page's url and of its canonical links and refresh targets, all of them, against the page's base."""
    body, own = F.coalesce(F.col(html), F.lit("")), F.col(url)
    tags = lambda pattern: F.regexp_extract_all(body, F.lit(pattern), F.lit(1))
    canonical = F.transform(F.filter(tags(LINK_TAG), lambda x: x.rlike(CANONICAL)), lambda x: decoded(_attribute(x, HREF)))
    refresh = F.transform(F.filter(tags(META_TAG), lambda x: x.rlike(REFRESH_TAG)), lambda x: F.regexp_extract(decoded(_attribute(x, CONTENT)), REFRESH_URL, 1))
    href = decoded(_attribute(F.coalesce(F.get(tags(BASE_TAG), 0), F.lit("")), HREF))
    told = body.rlike(r"(?i)<link\b[^>]*canonical|<meta\b[^>]*refresh")  # most pages name no other url
    once = lambda x: F.explode(F.array(x))  # noqa: E731  a generator keeps the optimizer from copying x into each of its uses
    found = pages.where(told).select(own.alias("own"), once(F.struct(href.alias("href"), F.concat(canonical, refresh).alias("targets"))).alias("x"))
    found = found.select("own", F.col("x.href").alias("href"), F.explode("x.targets").alias("target")).where("target <> ''")
    base = F.when(F.col("href") == "", F.col("own")).otherwise(F.coalesce(resolved(F.col("own"), F.col("href")), F.col("own")))
    found = found.select("own", "target", once(base).alias("base")).select("own", once(resolved(F.col("base"), F.col("target"))).alias("full"))
    return found.select(alias_key(F.col("own")).alias("a"), alias_key(F.col("full")).alias("b")).where("a is not null and b is not null and a <> b")


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]], *, redirects: DataFrame | None = None, key: str = "page_id", url: str = "url", html: str | None = "html"
) -> DataFrame:
    """One row per page: key, host, path, rule, verdict, by (own rule, else the alias class, else allow).

    rules: (allow or block, host, path start). redirects: optional (src, dst) urls.
    """
    host, path = split_url(F.col(url))
    links = page_links(pages, url, html) if html else None
    if redirects is not None:
        given = redirects.select(alias_key(F.col("src")).alias("a"), alias_key(F.col("dst")).alias("b")).where("a is not null and b is not null")
        links = given if links is None else links.union(given)
    judged = best_rule(pages.select(F.col(key).alias("k"), F.col(url).alias("u"), host.alias("host"), path.alias("path")), rules)
    if links is None:
        classes = None
    else:
        members = connected_components(links)
        at = F.concat(F.lit("x://"), F.col("node"))
        node_host, node_path = split_url(at)
        votes = best_rule(members.select("node", "component", node_host.alias("host"), node_path.alias("path")), rules)
        class_verdict = votes.groupBy("component").agg(
            F.max(F.col("rule_verdict") == "allow").alias("allowed"), F.max(F.col("rule_verdict") == "block").alias("blocked")
        )
        classes = members.join(class_verdict, "component").select(
            F.col("node").alias("alias"), F.when(~F.coalesce("allowed", F.lit(False)) & F.col("blocked"), "block").otherwise("allow").alias("class_verdict")
        )
    if classes is None:
        judged = judged.withColumn("class_verdict", F.lit(None).cast("string"))
    else:
        # a url without an alias key meets none; its row is dealt by its own key
        alias = F.coalesce(alias_key(F.col("u")), F.concat(F.lit("\n"), F.col("k").cast("string")), F.lit("\n"))
        judged = judged.withColumn("alias", alias).join(small_or_joined(classes), "alias", "left")
    by = F.when(F.col("rule").isNotNull(), "rule").when(F.col("class_verdict").isNotNull(), "class").otherwise("default")
    return judged.select(
        F.col("k").alias(key), "host", "path", "rule", F.coalesce("rule_verdict", "class_verdict", F.lit("allow")).alias("verdict"), by.alias("decided_by")
    )
