"""Mixing sources to target weights by hierarchical budgets. DataFrame functions only.

Weights stand in a tree of domain, language and source; a total of tokens goes
down from its root. A node takes no more than its documents give over the allowed
epochs. What it cannot take goes to its siblings by weight, and only what a whole
family cannot take goes to the siblings of the parent: budgets are shared out from
the top, and no family gets more than all its leaves have room for. Each leaf
gives its documents in an order seeded anew for each epoch: whole epochs first,
then the prefix of the next that its budget still holds.

A leaf may hold most rows. Its order is cut into buckets, whose sums show the one
bucket in which the prefix ends; only that bucket's rows are ranked, and all other
rows are decided where they stand. The tables of leaves that rows meet have a row
per leaf and are staged, so that Spark broadcasts them only if they are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

LEVELS = ("domain", "lang", "source")
#: Hexadecimal digits of the seeded order that name a bucket: 4096 buckets a leaf.
DIGITS = 3
WORDS = r"[^ \t\n\r\f\x0B]+"


def n_words(text: Column) -> Column:
    """Words of a text between ASCII white space, the token count by default."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def weight_of(weights: dict[tuple[str, ...], int], path: list[str]) -> Column:
    """The weight of the node at a path of columns: that of its path, else of its last name at that level, else 1."""
    own = {k: w for k, w in weights.items() if len(k) == len(path)}
    if not own:
        return F.lit(1)
    by_path = F.create_map(*(x for k, w in own.items() for x in (F.lit("\x01".join(k)), F.lit(w))))
    key = F.concat_ws("\x01", *path)
    any_parent = F.concat_ws("\x01", *(F.lit("*") for _ in path[:-1]), F.col(path[-1]))
    return F.coalesce(by_path[key], by_path[any_parent], F.lit(1))


def shared_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Budgets of one level: nodes have the parent's columns and `budget`, their name, weight and room.

    Nodes in the order of room for each unit of weight are full as long as an even
    share of what is left gives them their room. The others share the rest by
    weight; tokens that don't divide, fewer than nodes, go to the first by name.
    """
    family = ", ".join(f"`{p}`" for p in parent) or "1"
    order = f"PARTITION BY {family} ORDER BY room * 1.0D / weight, `{name}`"
    rows = nodes.selectExpr(
        "*",
        f"budget - coalesce(sum(room) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest",
        f"sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open",
    )
    rows = rows.selectExpr("*", "CAST(rest AS DECIMAL(38,0)) * weight >= CAST(room AS DECIMAL(38,0)) * open AS full")
    rows = rows.selectExpr("*", f"max(CASE WHEN NOT full THEN rest END) OVER (PARTITION BY {family}) AS left", f"max(CASE WHEN NOT full THEN open END) OVER (PARTITION BY {family}) AS units")
    rows = rows.selectExpr("*", "CASE WHEN full THEN room ELSE CAST(CAST(left AS DECIMAL(38,0)) * weight DIV units AS BIGINT) END AS share")
    rows = rows.selectExpr("*", f"left - sum(CASE WHEN NOT full THEN share END) OVER (PARTITION BY {family}) AS odd", f"row_number() OVER (PARTITION BY {family}, full ORDER BY `{name}`) AS place")
    return rows.selectExpr(*(f"`{p}`" for p in parent), f"`{name}`", "share + CASE WHEN NOT full AND place <= odd THEN 1 ELSE 0 END AS budget")


def budgets(leaves: DataFrame, weights: dict[tuple[str, ...], int], total: int | None, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """The budget of each leaf. leaves: the levels' columns, tokens, room; total None: the sum of tokens. Nodes of weight 0 or less get nothing."""
    sure = leaves
    for k in range(len(levels)):
        sure = sure.filter(weight_of(weights, list(levels[: k + 1])) > 0)
    whole = F.sum("tokens") if total is None else F.lit(total)
    top = leaves.agg(F.coalesce(whole, F.lit(0)).cast("long").alias("most"))
    now = sure.agg(F.coalesce(F.sum("room"), F.lit(0)).alias("room")).crossJoin(top).select(F.least("room", "most").alias("budget"))  # one row by one row
    for k, level in enumerate(levels):
        above = list(levels[:k])
        nodes = sure.groupBy(*above, level).agg(F.sum("room").alias("room")).withColumn("weight", weight_of(weights, [*above, level]))
        nodes = nodes.join(now, above) if above else nodes.crossJoin(now)  # a row for each domain by one row
        now = shared_out(nodes, above, level)
    return now


def seeded(seed: int, epoch: Column, doc: Column) -> Column:
    """The order of documents in an epoch: the MD5 of seed, epoch and doc_id as text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc.cast("string"), F.lit("null"))).cast("binary"))


def mix(docs: DataFrame, weights: dict[tuple[str, ...], int], total: int | None = None, epochs: int = 4, seed: int = 17, domain: Column | None = None, tokens: Column | None = None) -> DataFrame:
    """The documents (doc_id, text, lang, source and any other columns) that the budgets select, with mix_domain, mix_epoch, mix_tokens.

    weights: of (domain,), (domain, lang) and (domain, lang, source); "*" stands for
    any parents, and 1 holds where none is given. domain: a column over docs (by
    default its column domain); tokens: a column with a document's tokens (by
    default its words). Null names count as the empty name, null texts as 0 tokens.
    Of equal doc_ids the order is that of their texts. A document is selected once
    for every epoch that reaches it: wholly, or in the prefix of documents whose
    tokens add up to at most what is left. Columns of docs whose names start with
    mix_ are left out. No documents give no rows.
    """
    columns = [c for c in docs.columns if not c.startswith("mix_")]
    named = docs.select(
        *(F.col(f"`{c}`") for c in columns),
        F.coalesce((F.col("domain") if domain is None else domain).cast("string"), F.lit("")).alias("mix_domain"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("mix_lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("mix_source"),
        (n_words(F.col("text")) if tokens is None else tokens).alias("mix_tokens"),
    )
    levels = ("mix_domain", "mix_lang", "mix_source")
    leaves = common.staged(named.groupBy(*levels).agg(F.sum("mix_tokens").alias("tokens")).withColumn("room", F.col("tokens") * epochs), "leaves")
    plan = leaves.join(budgets(leaves, weights, total, levels), list(levels)).filter("tokens > 0")
    plan = common.staged(plan.selectExpr(*levels, "CAST(budget DIV tokens AS INT) AS mix_whole", "budget % tokens AS mix_part"), "budgets")

    def met(table: DataFrame) -> DataFrame:
        order = seeded(seed, F.col("mix_whole"), F.col("doc_id"))
        return named.join(table, list(levels)).withColumn("mix_order", order).withColumn("mix_bucket", F.substring("mix_order", 1, DIGITS))

    sums = met(plan).filter("mix_part > 0").groupBy(*levels, "mix_bucket").agg(F.sum("mix_tokens").alias("n"), F.max("mix_part").alias("part"))
    before = Window.partitionBy(*levels).orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).filter("before <= part and before + n > part")
    ends = ends.groupBy(*levels).agg(F.min(F.struct("mix_bucket", "before")).alias("end"))
    full = common.staged(plan.join(ends, list(levels), "left").selectExpr(*levels, "mix_whole", "mix_part", "end.mix_bucket AS mix_last", "end.before AS mix_before"), "ends")
    # Buckets before the last are in, those after it out; in a leaf without a last bucket the next epoch's prefix is all of it or nothing.
    sure = met(full).withColumn("mix_epochs", F.expr("mix_whole + CASE WHEN mix_part > 0 AND (mix_last IS NULL OR mix_bucket < mix_last) THEN 1 ELSE 0 END"))
    apart = F.expr("mix_part > 0 AND mix_last IS NOT NULL AND mix_bucket = mix_last")
    running = F.sum("mix_tokens").over(Window.partitionBy(*levels, "mix_bucket").orderBy("mix_order", "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0))
    edge = sure.filter(apart).withColumn("mix_sum", running).withColumn("mix_epochs", F.expr("mix_whole + CASE WHEN mix_before + mix_sum <= mix_part THEN 1 ELSE 0 END")).drop("mix_sum")
    taken = sure.filter(~apart).unionByName(edge).filter("mix_epochs > 0")
    return taken.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.col("mix_epochs") - 1))).select(*(F.col(f"`{c}`") for c in columns), "mix_domain", "mix_epoch", "mix_tokens")


#: The weights of the registered query, in SQL and as a tree.
WEIGHTS = {("web",): 50, ("reference",): 30, ("forum",): 20, ("*", "en"): 60, ("*", "de"): 15, ("*", "fr"): 15, ("*", "es"): 10}
DOMAIN = "CASE WHEN source = 'src0' THEN 'web' WHEN length(source) = 4 THEN 'reference' ELSE 'forum' END"


def oracle(weights: dict[tuple[str, ...], int] = WEIGHTS, domain: str = DOMAIN, epochs: int = 4, seed: int = 17) -> str:
    """mix() in DuckDB's SQL over `documents`: doc_id, domain, lang, source, epoch, n_tokens."""

    def weight(k: int) -> str:
        cases = "".join(f" WHEN {'mix_domain mix_lang mix_source'.split()[k]} = '{p[-1]}'" + "".join(f" AND {c} = '{v}'" for c, v in zip("mix_domain mix_lang".split(), p[:-1], strict=False) if v != "*") + f" THEN {w}" for p, w in weights.items() if len(p) == k + 1)
        return f"CASE{cases} ELSE 1 END" if cases else "1"

    def level(k: int) -> str:
        names = ["mix_domain", "mix_lang", "mix_source"]
        above, name = names[:k], names[k]
        family, own = ", ".join(above) or "1", ", ".join([*above, name])
        source = f"n{k} JOIN b{k - 1} USING ({family})" if k else "n0 CROSS JOIN top"
        order = f"PARTITION BY {family} ORDER BY room * 1.0::DOUBLE / weight, {name}"
        return f"""
n{k} AS (SELECT {own}, sum(room) AS room, {weight(k)} AS weight FROM leaves GROUP BY {own}),
o{k} AS (SELECT *, budget - coalesce(sum(room) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM {source}),
f{k} AS (SELECT *, rest::HUGEINT * weight >= room::HUGEINT * open AS isfull FROM o{k}),
p{k} AS (SELECT *, max(CASE WHEN NOT isfull THEN rest END) OVER (PARTITION BY {family}) AS remain, max(CASE WHEN NOT isfull THEN open END) OVER (PARTITION BY {family}) AS units FROM f{k}),
s{k} AS (SELECT *, CASE WHEN isfull THEN room ELSE (remain::HUGEINT * weight) // units END AS share FROM p{k}),
t{k} AS (SELECT *, remain - sum(CASE WHEN NOT isfull THEN share END) OVER (PARTITION BY {family}) AS odd, row_number() OVER (PARTITION BY {family}, isfull ORDER BY {name}) AS place FROM s{k}),
b{k} AS (SELECT {own}, share + CASE WHEN NOT isfull AND place <= odd THEN 1 ELSE 0 END AS budget FROM t{k}),"""

    return f"""
WITH named AS (SELECT doc_id, text, {domain} AS mix_domain, lang AS mix_lang, source AS mix_source, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+'))::BIGINT AS tok FROM documents),
leaves AS (SELECT mix_domain, mix_lang, mix_source, sum(tok)::BIGINT AS tokens, sum(tok)::BIGINT * {epochs} AS room FROM named GROUP BY ALL),
top AS (SELECT least(sum(room), sum(tokens)) AS budget FROM leaves),{level(0)}{level(1)}{level(2)}
plan AS (SELECT mix_domain, mix_lang, mix_source, (budget // tokens)::BIGINT AS whole, (budget % tokens)::BIGINT AS part FROM b2 JOIN leaves USING (mix_domain, mix_lang, mix_source) WHERE tokens > 0),
met AS (SELECT *, md5('{seed}:' || whole || ':' || doc_id) AS seeded FROM named JOIN plan USING (mix_domain, mix_lang, mix_source)),
summed AS (SELECT *, sum(tok) OVER (PARTITION BY mix_domain, mix_lang, mix_source ORDER BY seeded, doc_id, text ROWS UNBOUNDED PRECEDING) AS upto FROM met),
taken AS (SELECT *, unnest(range(whole + CASE WHEN part > 0 AND upto <= part THEN 1 ELSE 0 END)) AS epoch FROM summed)
SELECT doc_id, mix_domain AS domain, mix_lang AS lang, mix_source AS source, epoch::INTEGER AS epoch, tok AS n_tokens FROM taken"""
