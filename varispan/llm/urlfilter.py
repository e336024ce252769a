"""URL filter: host and path rules, and blocks that follow redirects and canonical links to aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components

#: (rule, verdict); a rule is host/path.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: Rules beyond this number must come as a table (``rule_join``), not as an expression.
MOST_INLINE = 200

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(h: Column, p: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    if len(rules) > MOST_INLINE:
        raise ValueError(f"over {MOST_INLINE} rules: use rule_join")
    out = None
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r)):
        rh, slash, rp = rule.partition("/")
        fits = ((h == rh) | h.endswith("." + rh)) & p.startswith(slash + rp)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def rule_join(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The same over a table of rules (rule, verdict) of any size: ``urls`` (host, path) with a column ``own``. Distinct hosts meet rules on each of their suffixes; a host's matches then join its urls."""
    table = rules.select(F.split_part(F.col("rule"), F.lit("/"), F.lit(1)).alias("suffix"), F.expr("substring(rule, instr(rule, '/'))").alias("prefix"), "rule", "verdict")
    hosts = urls.select("host").distinct()
    parts = F.split("host", r"\.")
    suffixes = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("suffix"))
    found = suffixes.join(table, "suffix").groupBy("host").agg(F.collect_list(F.struct("prefix", "rule", "verdict")).alias("fit"))
    best = F.expr("array_max(transform(filter(fit, f -> startswith(path, f.prefix)), f -> struct(length(f.rule) as n, f.rule as rule, f.verdict as verdict)))")
    out = urls.join(found, "host", "left").withColumn("best", best)
    return out.withColumn("own", F.when(F.col("best").isNotNull(), F.struct(F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict")))).drop("best", "fit")


def node(url: Column) -> Column:
    """A url as a graph node: host, path and query, without scheme and fragment."""
    return F.concat(host(url), path(url), F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1), F.lit("")))


def no_dots(p: Column) -> Column:
    """A path from the root without its . and .. segments (RFC 3986, 5.2.4)."""
    parts = F.split(p, "/")
    up = lambda acc: F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
    step = lambda acc, x: F.when(x == "..", up(acc)).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))
    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"), step)
    # a last . or .. names a folder
    kept = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def absolute(link: Column, base: Column) -> Column:
    """A link resolved against its page (RFC 3986, 5.2); links of a scheme without ``://``, such as mailto:, give null."""
    link = F.replace(F.trim(link), F.lit("&amp;"), F.lit("&"))
    origin = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    own, rest = F.regexp_extract(link, r"(?s)^([^?#]*)", 1), F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.concat(F.lit("/"), F.regexp_extract(path(base), r"(?s)^/(.*/)", 1))
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("/"), F.concat(origin, no_dots(own), rest))
        .when(link.startswith("?"), F.concat(origin, path(base), link))
        .when(link.startswith("#"), F.concat(F.regexp_extract(base, r"(?s)^([^#]*)", 1), link))
        .when(link != "", F.concat(origin, no_dots(F.concat(folder, own)), rest))
    )


_CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?\s*([^"'\s>]+)"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?[^"'>]*?url\s*=\s*["']?\s*([^"'\s>]+)"""


def html_links(pages: DataFrame) -> DataFrame:
    """Edges (a, b) between nodes: each page's canonical link and its redirect by refresh, where they lead elsewhere."""
    low = F.lower("html")
    seen = pages.where(F.col("url").contains("://") & (low.contains("canonical") | low.contains("refresh")))
    goal = F.explode(F.array(F.regexp_extract("html", _CANONICAL, 1), F.regexp_extract("html", _REFRESH, 1)))
    out = seen.select("url", goal.alias("link")).where("link <> ''").select(node(F.col("url")).alias("a"), node(absolute(F.col("link"), F.col("url"))).alias("b"))
    return out.where("a <> b and b <> ''")


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict.

    A page with a rule of its own has that rule's verdict, so an explicit allow is never overruled. Any other
    page takes its component's: block if some member (crawled or only linked to) is blocked by a rule and
    none is explicitly allowed, else allow. Components are over ``redirects`` (from_url, to_url) and the pages' own
    canonical and refresh links. Null urls, and those without ``://``, have empty host and path, no rule,
    no aliases, and are allowed. Null html has no links. Repeated rows come out as often as they came in;
    other columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(pages.sparkSession, "url")
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    edges = html_links(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(node(F.col("from_url")).alias("a"), node(F.col("to_url")).alias("b")).where("a <> b and a <> '' and b <> ''"))
    roots = connected_components(edges, scratch)
    members = roots.withColumn("own", rule_of(host(F.concat(F.lit("x://"), "node")), path(F.concat(F.lit("x://"), "node")), rules))
    state = members.groupBy("root").agg(F.bool_or(F.coalesce(F.col("own.verdict") == "block", F.lit(False))).alias("block"), F.bool_or(F.coalesce(F.col("own.verdict") == "allow", F.lit(False))).alias("allow"))
    blocked = scratch.save(roots.join(state.where("block and not allow"), "root").select("node", F.lit(True).alias("aliased")), "blocked")
    rows = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rows = rows.withColumn("own", rule_of(F.col("host"), F.col("path"), rules)).withColumn("node", node(F.col("url")))
    out = rows.join(blocked, "node", "left")
    verdict = F.coalesce(F.col("own.verdict"), F.when(F.col("aliased"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"))


def op2_urlfilter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def chained(pages: DataFrame) -> DataFrame:
    """(from_url, to_url): made-up redirects that tie pages of four ids in a row together, so that aliases occur in tables without any."""
    after = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("to_url"))
    return pages.where("page_id % 4 <> 3").select("page_id", F.col("url").alias("from_url")).join(after, "page_id").select("from_url", "to_url")


def redirected_urls(spark, sf_dir: str) -> DataFrame:
    """The verdicts with those redirects besides the pages' own links."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge(pages, redirects=chained(pages))


_SQL_NODE = r"""(translate(regexp_extract({u}, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract({u}, '^.*?://[^/?#]*([^?#]*)', 1, 's') || regexp_extract({u}, '^.*?://[^?#]*(\?[^#]*)', 1, 's'))"""
_SQL = rf"""
with recursive p as (
  select page_id, url, html,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path,
    {_SQL_NODE.format(u="url")} as node
  from pages),
rules(rule, rh, rp, verdict) as (values ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
link as (
  select url, node, unnest(list_transform([
    regexp_extract(regexp_extract(html, '<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0, 'is'), '\bhref\s*=\s*["'']?([^"''\s>]+)', 1, 'is'),
    regexp_extract(regexp_extract(html, '<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0, 'is'), 'url\s*=\s*([^"''\s>]+)', 1, 'is')], lambda x: replace(trim(x), '&amp;', '&'))) as link
  from p where contains(url, '://')),
whole as (
  select node as a, case when regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') then link when starts_with(link, '//') then 'http:' || link when starts_with(link, '/') then regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's') || link end as link
  from link where link <> ''),
edge as (select a, {_SQL_NODE.format(u="link")} as b from whole where link is not null{{more}}),
both_ways as (select a, b from edge where a <> b and b <> '' union select b, a from edge where a <> b and b <> ''),
reach(a, b) as (select a, a from both_ways union select r.a, e.b from reach r join both_ways e on r.b = e.a),
fit as (
  select n.host, n.path, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict
  from (select host, path from p union select split_part(split_part(b, '/', 1), '?', 1), regexp_extract(b, '^[^/?#]*([^?#]*)', 1) from reach) n
  join rules on (n.host = rh or ends_with(n.host, '.' || rh)) and starts_with(n.path, rp) group by 1, 2),
state as (
  select r.a as node, bool_or(coalesce(f.verdict = 'block', false)) as block, bool_or(coalesce(f.verdict = 'allow', false)) as allow
  from reach r left join fit f on f.host = split_part(split_part(r.b, '/', 1), '?', 1) and f.path = regexp_extract(r.b, '^[^/?#]*([^?#]*)', 1) group by 1)
select p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, case when s.block and not s.allow then 'block' else 'allow' end) as verdict
from p left join fit f on p.host = f.host and p.path = f.path left join state s on s.node = p.node
"""
SQL = _SQL.replace("{more}", "")
SQL_REDIRECTED = _SQL.replace("{more}", " union all select p.node, q.node from p join p q on q.page_id = p.page_id + 1 where p.page_id % 4 <> 3 and p.node <> '' and q.node <> ''")
