"""Operator 2, mixing sources to target weights (DataFrame functions only).

A source of token share p gets the weight p**a / sum(p**a). The exponent a is bisected (64 cells a job, so that one job takes six halvings)
until the weights meet a target entropy or a repetition limit. The weights are realised within a token budget: the documents of a source
are dealt into blocks by a hash; every epoch has its own permutation of the blocks; whole blocks are taken until the source's budget ends,
and the block at the end is cut within. Sums run over blocks, never over the documents of a source, so a hot source has no task of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragloom.llm.common import safe_text, table, words, written

CELLS, ROUNDS = 64, 3


def _hash(*parts) -> Column:
    """A 60-bit hash that other SQL engines can compute too."""
    joined = F.concat_ws("|", *(p if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def bisect_exponent(shares: DataFrame, *, budget_ratio: float, max_repetition: float | None = None, target_entropy: float | None = None) -> float:
    """The exponent in [0, 1]: the smallest that keeps to max_repetition, or the largest that keeps target_entropy (nats).

    shares: one row per source with its share p > 0. Each round sends one row per cell to the driver, however many sources there are.
    """
    if (max_repetition is None) == (target_entropy is None):
        raise ValueError("give either max_repetition or target_entropy")
    low, high = 0.0, 1.0
    p = F.col("p")
    for _ in range(ROUNDS):
        grid = [low + (high - low) * i / CELLS for i in range(CELLS + 1)]
        at = shares.select("p", F.posexplode(F.array(*map(F.lit, grid))).alias("i", "a"))
        sums = at.groupBy("i").agg(F.sum(F.pow("p", "a")).alias("z"), F.max(F.pow(p, F.col("a") - 1)).alias("m"), F.sum(F.pow("p", "a") * F.col("a") * F.log("p")).alias("e")).collect()
        by = {r["i"]: r for r in sums}
        if not by:
            return 1.0
        if max_repetition is not None:
            fits = [i for i in range(CELLS + 1) if budget_ratio * by[i]["m"] / by[i]["z"] <= max_repetition]
            cell = min(fits, default=CELLS)
            low, high = grid[max(0, cell - 1)], grid[cell]
        else:
            import math

            fits = [i for i in range(CELLS + 1) if math.log(by[i]["z"]) - by[i]["e"] / by[i]["z"] >= target_entropy]
            cell = max(fits, default=0)
            low, high = grid[cell], grid[min(CELLS, cell + 1)]
    return high if max_repetition is not None else low


def mixing_plan(sized: DataFrame, *, budget_tokens: int | None, max_repetition: float | None, target_entropy: float | None, block_rows: int, seed: str) -> tuple[DataFrame, DataFrame, int]:
    """(sources with their weights, plan rows (source, block, epoch, before, budget, cut), budget).

    `before` is the number of the source's tokens ahead of the block, `cut` the last document hash that is taken (null: the whole block).
    """
    by_source = written(sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens")), "mix-sources")
    total = by_source.agg(F.sum("tokens")).first()[0] or 0
    budget = total if budget_tokens is None else budget_tokens
    shares = by_source.where("tokens > 0").select("source", "docs", "tokens", (F.col("tokens") / F.lit(float(max(1, total)))).alias("p"))
    exponent = bisect_exponent(shares, budget_ratio=budget / max(1, total), max_repetition=max_repetition, target_entropy=target_entropy)
    z = shares.agg(F.sum(F.pow("p", F.lit(exponent)))).first()[0] or 1.0
    weights = shares.select("source", "tokens", F.ceil(F.col("docs") / block_rows).cast("long").alias("blocks"), (F.pow("p", F.lit(exponent)) / z).alias("weight"))
    weights = weights.withColumn("budget", F.floor(F.col("weight") * float(budget)).cast("long")).withColumn("epochs", F.floor(F.col("budget") / F.col("tokens")).cast("long"))

    placed = sized.join(weights.select("source", "blocks"), "source").withColumn("block", F.pmod("h", "blocks"))
    blocks = placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens"))
    runs = blocks.join(weights, "source").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs"))))
    order = Window.partitionBy("source", "epoch").orderBy(_hash(seed, F.col("epoch"), F.col("block")), "block").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.col("epoch") * F.col("tokens") + F.coalesce(F.sum("block_tokens").over(order), F.lit(0)))
    runs = written(runs.where(F.col("before") < F.col("budget")).select("source", "block", "epoch", "before", "budget", (F.col("before") + F.col("block_tokens") > F.col("budget")).alias("last")), "mix-blocks")
    # at most one block a source ends beyond the budget: only its documents are ordered, by their hash, equal hashes together
    edge = placed.join(runs.where("last").select("source", "block", "epoch", (F.col("budget") - F.col("before")).alias("room")), ["source", "block"])
    upto = F.sum("n_tokens").over(Window.partitionBy("source").orderBy("h").rangeBetween(Window.unboundedPreceding, 0))
    cuts = edge.withColumn("upto", upto).groupBy("source", "block", "epoch").agg(F.coalesce(F.max(F.when(F.col("upto") <= F.col("room"), F.col("h"))), F.lit(-1)).alias("cut"))
    plan = runs.join(cuts, ["source", "block", "epoch"], "left").select("source", "block", "epoch", "before", "budget", "cut")
    return weights, plan, budget


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget_tokens: int | None = None, max_repetition: float | None = 1.25, target_entropy: float | None = None, mix_tokens: int = 1_000_000, block_rows: int = 512, seed: str = "mix") -> DataFrame:
    """The rows of `docs`, each as often as its source's weight asks for, with `mix_epoch` and `mix_block` (columns so named are replaced).

    mix_block numbers stretches of the mixed stream of about mix_tokens tokens, in each of which the sources have their weights; within
    one, order by any hash. budget_tokens: None for as many tokens as there are. Every source gets its weight's tokens less at most one
    document. Defined results: a null source is the source ''; a null text has no tokens; sources without tokens have no weight, so their
    rows go; repeated rows and ids are rows of their own that are taken together; an empty table gives no rows; a limit that no exponent
    meets gives the nearest one.
    """
    source, key = F.coalesce(F.col(source_col).cast("string"), F.lit("")), _hash(seed, F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    sized = written(docs.select(source.alias("source"), key.alias("h"), F.size(words(safe_text(text_col))).cast("long").alias("n_tokens")), "mix-sized")
    weights, plan, budget = mixing_plan(sized, budget_tokens=budget_tokens, max_repetition=max_repetition, target_entropy=target_entropy, block_rows=block_rows, seed=seed)
    n_mix = max(1, -(-budget // mix_tokens))
    steps = plan.join(weights.select("source", "blocks"), "source").select(
        F.col("source").alias("_source"), F.col("block").alias("_block"), "blocks", F.col("cut").alias("_cut"), F.col("epoch").alias("_epoch"),
        F.floor(F.col("before").cast("double") * float(n_mix) / F.col("budget").cast("double")).cast("long").alias("_mix"),
    )
    # a document finds its block through its source's number of blocks, then the block's epochs
    numbers = weights.select(F.col("source").alias("_source"), F.col("blocks").alias("_blocks"))
    keyed = docs.drop("mix_epoch", "mix_block").withColumn("_source", source).withColumn("_h", key).join(numbers, "_source").withColumn("_block", F.pmod("_h", "_blocks"))
    taken = keyed.join(steps.drop("blocks"), ["_source", "_block"]).where(F.col("_cut").isNull() | (F.col("_h") <= F.col("_cut")))
    return taken.withColumnsRenamed({"_epoch": "mix_epoch", "_mix": "mix_block"}).drop("_source", "_block", "_blocks", "_cut", "_h")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "source", "mix_epoch", "mix_block")


def _grid(name: str, before: str) -> str:
    """One round of the bisection in SQL: the interval that `before` has, cut into cells."""
    return f"""
{name}_g AS (SELECT i, lo + (hi - lo) * i / 64 AS a FROM {before}, (SELECT unnest(range(0, 65)) AS i)),
{name}_s AS (SELECT i, sum(pow(p, a)) AS z, max(pow(p, a - 1)) AS m FROM shares, {name}_g GROUP BY i),
{name}_c AS (SELECT coalesce(min(i), 64) AS c FROM {name}_s WHERE m / z <= 1.25),
{name} AS (SELECT max(CASE WHEN i = greatest(c - 1, 0) THEN a END) AS lo, max(CASE WHEN i = c THEN a END) AS hi FROM {name}_g, {name}_c)"""


OP2_SQL = rf"""
WITH d AS (SELECT doc_id, source AS src, coalesce(source, '') AS source, CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h,
                  len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n FROM documents),
b AS (SELECT source, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM d GROUP BY source HAVING sum(n) > 0),
t AS (SELECT CAST(sum(tokens) AS BIGINT) AS total FROM b),
shares AS (SELECT source, docs, tokens, tokens / CAST(total AS DOUBLE) AS p FROM b, t),
r0 AS (SELECT 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi),{_grid("r1", "r0")},{_grid("r2", "r1")},{_grid("r3", "r2")},
z AS (SELECT hi AS a, (SELECT sum(pow(p, hi)) FROM shares) AS z FROM r3),
w AS (SELECT source, tokens, CAST(ceil(docs / 512.0) AS BIGINT) AS blocks, CAST(floor(pow(p, a) / z.z * total) AS BIGINT) AS budget FROM shares, z, t),
k AS (SELECT doc_id, src, d.source, h, n, h % blocks AS block FROM d JOIN w USING (source)),
e AS (SELECT source, block, sum(n) AS bt FROM k GROUP BY source, block),
u AS (SELECT source, block, bt, tokens, budget, unnest(range(0, budget // tokens + 1)) AS epoch FROM e JOIN w USING (source)),
o AS (SELECT *, epoch * tokens + coalesce(sum(bt) OVER (PARTITION BY source, epoch ORDER BY CAST('0x' || substr(md5('mix|' || epoch || '|' || block), 1, 15) AS BIGINT), block
                                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u),
f AS (SELECT *, CASE WHEN before + bt > budget THEN budget - before END AS room FROM o WHERE before < budget),
x AS (SELECT doc_id, src AS source, epoch, before, budget, room, sum(n) OVER (PARTITION BY k.source, k.block, epoch ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
      FROM k JOIN f ON k.source = f.source AND k.block = f.block)
SELECT doc_id, source, epoch AS mix_epoch, CAST(floor(CAST(before AS DOUBLE) * greatest(1, ceil(total / 1000000.0)) / CAST(budget AS DOUBLE)) AS BIGINT) AS mix_block
FROM x, t WHERE room IS NULL OR upto <= room
"""
