"""Mixing to target weights: hierarchical token budgets and seeded prefixes, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

LEVELS = ("domain", "lang", "source")
DOMAIN = "case when try_cast(substring(source, 4) as int) < 10 then 'web' when try_cast(substring(source, 4) as int) >= 10 then 'curated' else 'other' end"
_WORD = r"[^ \t\n\x0B\f\r]+"


@dataclass(frozen=True)
class Mix:
    """Whole positive weights by name at each level (others: 1), share of all tokens to give out as a ratio, most passes over a leaf, seed, and rows per hash bin (a memory size; it never changes results)."""

    weights: dict = field(default_factory=lambda: {"domain": {"web": 3, "curated": 2}, "lang": {"en": 5, "de": 2, "fr": 2}, "source": {}})
    share: tuple[int, int] = (4, 5)
    max_epochs: int = 1
    seed: int = 7
    bin_rows: int = 4096

    def weight(self, level: str) -> Column:
        out = F.lit(1)
        for name, w in self.weights.get(level, {}).items():
            if w <= 0:
                raise ValueError(f"weight of {level} {name} must be positive")
            out = F.when(F.col(level) == name, w).otherwise(out)
        return out.cast("long")


def fill(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Split each parent's ``budget`` over its children by ``weight``, none above its ``cap``; what a full child can't take goes to its siblings.

    Children are ranked by cap / weight. If those before child i are full, the rest share at level
    (budget - their caps) / (remaining weight); that level rises while children fill and falls after, so its
    maximum is the one that holds.
    """
    group = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    ahead = group.orderBy(F.col("cap") / F.col("weight"), F.col(name).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(ahead), F.lit(0))) / (F.sum("weight").over(group) - F.coalesce(F.sum("weight").over(ahead), F.lit(0)))
    return nodes.withColumn("level", level).withColumn("budget", F.least(F.col("cap").cast("double"), F.col("weight") * F.max("level").over(group))).drop("level", "cap", "weight")


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """(domain, lang, source, tokens, docs, budget) from leaf totals. Each level is capped by what its subtree holds, so a shortage is made up among siblings first and reaches ancestors only when a whole subtree is short."""
    num, den = mix.share
    leaves = leaves.withColumn("cap", F.col("tokens") * mix.max_epochs)
    total = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * num / den).cast("double").alias("budget"))
    up: list[str] = []
    given = total
    for level in LEVELS:
        keys = [*up, level]
        nodes = leaves.groupBy(*keys).agg(F.sum("cap").alias("cap")).withColumn("weight", mix.weight(level))
        if up:
            same = [F.col(f"n.{k}").eqNullSafe(F.col(f"g.{k}")) for k in up]
            nodes = nodes.alias("n").join(given.alias("g"), same).select("n.*", "g.budget")
        else:
            nodes = nodes.crossJoin(F.broadcast(given))  # one row: the whole budget
        given = fill(nodes, up, level)
        up = keys
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"g.{k}")) for k in LEVELS]
    return leaves.alias("l").join(given.alias("g"), same).select(*[f"l.{k}" for k in LEVELS], "l.tokens", "l.docs", F.floor("g.budget").cast("long").alias("budget"))


def mixed(docs: DataFrame, mix: Mix | None = None, domain: str = DOMAIN) -> DataFrame:
    """``docs`` with _domain, _n, _epochs (whole passes over the row) and _prefix (tokens of it in the last, partial pass).

    A token is a run of characters other than ASCII white space; null text has none. The partial pass of
    a leaf takes its rows in the order of md5(seed:epoch:doc_id) up to the budget, cutting the last row. That order
    is met without sorting the leaf: rows fall into bins of the hash, whole bins below the cut are taken, and only
    the one bin at the cut is ranked. Null domain, lang or source form leaves of their own. Repeated rows
    count each for itself. An empty table gives an empty result. No column of ``docs`` may begin with
    an underscore followed by one of the names above.
    """
    mix = mix or Mix()
    scratch = Scratch(docs.sparkSession, "mix")
    known = {c: F.col(c) for c in docs.columns}
    base = docs.withColumn("_domain", F.expr(domain)).withColumn("_n", F.coalesce(F.regexp_count(F.col("text"), F.lit(_WORD)), F.lit(0)).cast("long"))
    keyed = base.select(F.col("_domain").alias("domain"), F.col("lang").alias("lang"), F.col("source").alias("source"), F.col("_n").alias("n"), "doc_id")
    rows = scratch.save(keyed, "rows")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n").alias("tokens"), F.count("*").alias("docs"))
    leaves = scratch.save(leaves, "leaves")
    plan = budgets(leaves, mix).withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0))
    plan = plan.withColumn("rest", F.when(F.col("tokens") > 0, F.col("budget") - F.col("epochs") * F.col("tokens")).otherwise(0)).withColumn("bins", F.expr(f"1 + docs div {mix.bin_rows}"))
    plan = scratch.save(plan.select(*LEVELS, "budget", "epochs", "rest", "bins"), "plan")

    def order(epochs: Column, doc_id: Column) -> Column:
        return F.md5(F.concat(F.lit(f"{mix.seed}:"), epochs.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))

    def bin_of(h: Column, bins: Column) -> Column:
        return F.shiftright(F.conv(F.substring(h, 1, 8), 16, 10).cast("long") * bins, 32)

    def leaf_join(left: DataFrame, names: dict[str, str], right: DataFrame) -> DataFrame:
        # a null-safe join on plain keys, so that a hot leaf's rows can be split by the skew rule
        for k in LEVELS:
            right = right.withColumnRenamed(k, f"_r_{k}")
        cond = [F.coalesce(F.col(names[k]), F.lit("\0")) == F.coalesce(F.col(f"_r_{k}"), F.lit("\0")) for k in LEVELS]
        return left.join(right, cond).drop(*[f"_r_{k}" for k in LEVELS])

    same = {k: k for k in LEVELS}
    binned = leaf_join(rows, same, plan).withColumn("bin", bin_of(order(F.col("epochs"), F.col("doc_id")), F.col("bins")))
    sums = binned.groupBy(*LEVELS, "bin", "rest").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("bin"))
    cut = sums.withColumn("upto", upto).where(F.col("upto") >= F.col("rest")).groupBy(*LEVELS).agg(F.min("bin").alias("cut"), F.min_by(F.col("upto") - F.col("n"), F.col("bin")).alias("before"))
    plan = scratch.save(leaf_join(plan, same, cut), "cuts").select(*LEVELS, F.col("budget").alias("_budget"), F.col("epochs").alias("_epochs"), F.col("rest").alias("_rest"), F.col("bins").alias("_bins"), F.col("cut").alias("_cut"), F.col("before").alias("_before"))
    out = leaf_join(base, {"domain": "_domain", "lang": "lang", "source": "source"}, plan)
    out = out.withColumn("_h", order(F.col("_epochs"), F.col("doc_id"))).withColumn("_bin", bin_of(F.col("_h"), F.col("_bins")))
    whole = out.where("_bin <> _cut").withColumn("_prefix", F.when(F.col("_bin") < F.col("_cut"), F.col("_n")).otherwise(0).cast("long"))
    ahead = F.coalesce(F.sum("_n").over(Window.partitionBy("_domain", "lang", "source").orderBy("_h", "doc_id", "_n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = out.where("_bin = _cut").withColumn("_prefix", F.greatest(F.lit(0), F.least(F.col("_n"), F.col("_rest") - F.col("_before") - ahead)).cast("long"))
    return whole.unionByName(part).select(*known, "_domain", "_n", "_budget", "_epochs", "_prefix")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    """Budgets of twice the largest whole passes, so that shortages occur at each level."""
    out = mixed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"), Mix(max_epochs=2, share=(6, 5)))
    return out.select("doc_id", F.col("_domain").alias("domain"), "lang", "source", F.col("_n").alias("n_tokens"), F.col("_budget").alias("leaf_budget"), F.col("_epochs").alias("epochs"), F.col("_prefix").alias("prefix_tokens"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one pass at most over each leaf; the rows drawn, that at the cut in whole."""
    return mixed(docs).where("_epochs > 0 or _prefix > 0").select(*docs.columns)


def _sql_weight(level: str) -> str:
    w = Mix().weights[level]
    return f"(case {' '.join(f"when {level} = '{k}' then {v}" for k, v in w.items())} else 1 end)::bigint" if w else "1::bigint"


def _sql_fill(name: str, keys: list[str], up: list[str], given: str) -> str:
    part = f"partition by {', '.join(up)}" if up else ""
    join = "join " + given + " g on " + " and ".join(f"n.{k} is not distinct from g.{k}" for k in up) if up else f"cross join {given} g"
    order = f"order by cap / weight, {keys[-1]} nulls first rows between unbounded preceding and 1 preceding"
    return f"""
{name}_n as (select {', '.join(f'n.{k}' for k in keys)}, n.cap, n.weight, g.budget from (select {', '.join(keys)}, sum(tokens * 2)::bigint as cap, {_sql_weight(keys[-1])} as weight from leaves group by {', '.join(keys)}) n {join}),
{name}_l as (select *, (budget - coalesce(sum(cap) over ({part} {order}), 0)::double) / (sum(weight) over ({part}) - coalesce(sum(weight) over ({part} {order}), 0))::double as level from {name}_n),
{name} as (select {', '.join(keys)}, least(cap::double, weight * max(level) over ({part})) as budget from {name}_l),"""


SQL = rf"""
with d as (
  select doc_id, lang, source, case when try_cast(substring(source, 4) as int) < 10 then 'web' when try_cast(substring(source, 4) as int) >= 10 then 'curated' else 'other' end as domain,
    coalesce(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')), 0)::bigint as n
  from documents),
leaves as (select domain, lang, source, sum(n)::bigint as tokens from d group by all),
total as (select floor(coalesce(sum(tokens), 0) * 6 / 5)::double as budget from leaves),
{_sql_fill("a", ["domain"], [], "total")}{_sql_fill("b", ["domain", "lang"], ["domain"], "a")}{_sql_fill("c", ["domain", "lang", "source"], ["domain", "lang"], "b")}
plan as (
  select l.*, floor(c.budget)::bigint as budget, case when tokens > 0 then floor(c.budget)::bigint // tokens else 0 end as epochs
  from leaves l join c on l.domain is not distinct from c.domain and l.lang is not distinct from c.lang and l.source is not distinct from c.source),
h as (
  select d.*, p.budget, p.epochs, case when tokens > 0 then p.budget - p.epochs * p.tokens else 0 end as rest, md5('7:' || p.epochs || ':' || coalesce(d.doc_id::varchar, '')) as h
  from d join plan p on d.domain is not distinct from p.domain and d.lang is not distinct from p.lang and d.source is not distinct from p.source)
select doc_id, domain, lang, source, n as n_tokens, budget as leaf_budget, epochs,
  greatest(0, least(n, rest - coalesce(sum(n) over (partition by domain, lang, source order by h, doc_id, n rows between unbounded preceding and 1 preceding), 0)))::bigint as prefix_tokens
from h
"""
