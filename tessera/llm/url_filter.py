"""URL filters with redirect equivalence, in DataFrame expressions only.

Every url gets its longest fitting rule.  Redirects (meta refresh) and canonical
links make urls aliases; the connected components of these links are found over
all pages, and a block by rule of any alias, linked pages outside the table
included, blocks the others.  A url's own rule comes first: an allowed url stays
allowed whatever its aliases.

Defined cases: a null url, or one without ``://``, has an empty host and path,
fits no rule, has no aliases and is allowed; null html has no links; a link to
the page itself, or one that is not http, is ignored; ``&amp;`` in a link stands for
``&``; repeated rows are judged
alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, durable

#: (verdict, host, path prefix)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
_SALTS = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"\A([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, or null.

    Rules are looked up by each suffix of the host, so their number costs little.
    """
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, h, p in rules:
        by_host.setdefault(h.lower(), []).append((p, h + p, verdict))
    if not by_host:
        return F.lit(None).cast("struct<rule: string, verdict: string>")
    entries = [x for h, rs in by_host.items() for x in (F.lit(h), F.array(*[F.struct(F.lit(p).alias("path"), F.lit(r).alias("rule"), F.lit(v).alias("verdict")) for p, r, v in rs]))]
    table = F.create_map(*entries)
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    own = F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(table, s)), lambda x: x.isNotNull()))
    fits = F.filter(own, lambda x: F.startswith(path, x["path"]))
    best = F.array_max(F.transform(fits, lambda x: F.struct(F.length(x["rule"]).alias("n"), x["rule"].alias("rule"), x["verdict"].alias("verdict"))))
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def node_of(url: Column) -> Column:
    """What makes two urls the same node: host, path and query; no scheme, no fragment."""
    return F.concat(host_of(url), F.regexp_extract(_rest(url), r"\A[^/?#]*([^#]*)", 1))


def links_of(html: Column, url: Column) -> Column:
    """Absolute targets of canonical links and meta refreshes."""
    tags = lambda name: F.regexp_extract_all(html, F.lit(rf"(?is)<{name}\b[^>]*>"), 0)
    canonical = F.transform(F.filter(tags("link"), lambda t: t.rlike(r"""(?is)\brel\s*=\s*["']?canonical\b""")), lambda t: F.regexp_extract(t, r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)""", 1))
    refresh = F.transform(F.filter(tags("meta"), lambda t: t.rlike(r"""(?is)\bhttp-equiv\s*=\s*["']?refresh\b""")), lambda t: F.regexp_extract(t, r"""(?is)\bcontent\s*=\s*["']?\s*\d*\s*[;,]\s*url\s*=\s*["']?([^"'\s>]+)""", 1))
    scheme, host = F.substring_index(url, "://", 1), host_of(url)
    base = F.regexp_extract(path_of(url), r"\A(.*/)", 1)

    def absolute(t: Column) -> Column:
        return (
            F.when(t.rlike(r"(?i)\Ahttps?://"), t)
            .when(F.startswith(t, F.lit("//")), F.concat(scheme, F.lit(":"), t))
            .when(F.startswith(t, F.lit("/")), F.concat(scheme, F.lit("://"), host, t))
            .when((t == "") | t.rlike(r"\A(#|[A-Za-z][A-Za-z0-9+.-]*:)"), None)
            .otherwise(F.concat(scheme, F.lit("://"), host, F.when(base == "", "/").otherwise(base), t))
        )

    return F.filter(F.transform(F.concat(canonical, refresh), lambda t: absolute(F.replace(t, F.lit("&amp;"), F.lit("&")))), lambda t: t.isNotNull())


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, component): ``component`` is the least alias, null without aliases."""
    url, html = F.col(url_col), F.col(html_col)
    judged = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), F.when(F.instr(url, "://") > 0, node_of(url)).alias("node"))
    judged = judged.withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    linking = pages.where(html.rlike("(?i)<(link|meta)\\b") & html.rlike("(?i)canonical|refresh") & (F.instr(url, "://") > 0))
    edges = durable(linking.select(node_of(url).alias("a"), F.explode(links_of(html, url)).alias("target")).select("a", node_of(F.col("target")).alias("b")).where("a <> b").distinct())
    members = components(edges)
    parts = F.concat(F.lit("x://"), F.col("node"))
    ruled = members.withColumn("own", rule_of(host_of(parts), path_of(parts), rules))
    state = ruled.groupBy("component").agg(F.max((F.col("own.verdict") == "block").cast("int")).alias("blocked"))
    verdicts = members.join(state, "component").select("node", "component", F.coalesce(F.col("blocked") == 1, F.lit(False)).alias("blocked"))
    # A hot url, and the pages without one, are dealt to ``_SALTS`` parts.
    salted = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt")
    judged = judged.withColumn("salt", F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(_SALTS)).cast("int"))
    out = judged.join(verdicts.select("*", salted), ["node", "salt"], "left")
    verdict = F.coalesce(F.col("own.verdict"), F.when(F.col("blocked"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"), "component")
