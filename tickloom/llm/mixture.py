"""Mixing sources to target weights: hierarchical budgets in tokens.

The budget goes down a tree of levels (domain, language, source). At every node it is shared among the children by
weight, and no child gets more than its subtree can give (tokens of its documents times ``max_epochs``). What one
child cannot give goes to its siblings by weight; only what all siblings together cannot give has, by the same
rule one level up, already gone to the parent's siblings. Shares are whole tokens and add up exactly.

A leaf then reads its documents in seeded epochs. Every epoch is a new order of the leaf by a hash of seed, epoch and
document; whole epochs are taken as they are, and of the last one the prefix that holds the rest of the leaf's budget,
the last document of it perhaps in part. To cut an epoch, tokens are added up per range of hash values first; only
the documents of the one range that holds the cut are ordered, so a leaf with a third of all rows is no single task.

Everything is DataFrame expressions. Rows: null texts and texts without words have no tokens and are never taken;
null level values form a child of their own, named ``""``; children without a given weight have weight 1, a weight of 0
or less takes nothing; rows that repeat an identifier are rows of their own, ordered by tokens where their hash ties. Empty tables give an
empty result. Clashing extra columns do not matter, only the named ones are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import checkpointed

RANGES = 4096
WORD = r"[^\x20\x09-\x0D]+"


def tokens_of(text: Column) -> Column:
    """The number of words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded_hash(seed: int, epoch: Column, doc: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), doc.cast("string")))


def share_out(children: DataFrame, parents: list[str], name: str, weights: dict[str, float]) -> DataFrame:
    """Gives ``budget`` of the parent to its children by weight, none above its ``cap``; adds ``amount``.

    Children that fill up first come first, by cap per weight; a child is full when the level at which the ones
    not yet full would share what is left reaches its cap. Weights count in millionths.
    """
    given = F.lit(1.0)
    for k, w in weights.items():
        given = F.when(F.col(name) == k, F.lit(float(w))).otherwise(given)
    units = F.greatest(F.round(given * 1_000_000), F.lit(0)).cast("decimal(18,0)")
    rows = (children.withColumn("w", units).where("w > 0 and cap > 0")
            .withColumn("fill", F.col("cap").cast("double") / F.col("w").cast("double")))
    side = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = side.orderBy("fill", name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("decimal(38,0)")

    def total(col: str, w) -> Column:
        return F.coalesce(F.sum(F.col(col).cast("decimal(28,0)")).over(w), zero)

    rows = rows.withColumns({
        "left_w": total("w", side) - total("w", before), "left_b": F.col("budget") - total("cap", before)})
    rows = rows.withColumn("full", (F.col("cap").cast("decimal(20,0)") * F.col("left_w")
                                    <= F.col("w") * F.col("left_b").cast("decimal(20,0)")))
    # fullness ends once and for all along the order
    rows = rows.withColumn("full", F.min(F.col("full").cast("int")).over(
        order.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    rest = rows.withColumns({
        "rest_b": F.greatest(F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(side), F.lit(0)), F.lit(0)),
        "rest_w": F.coalesce(F.sum(F.when(~F.col("full"), F.col("w"))).over(side), zero)})
    upto = F.coalesce(F.sum(F.when(~F.col("full"), F.col("w"))).over(order.rowsBetween(Window.unboundedPreceding, 0)), zero)

    def floor_share(w: Column) -> Column:
        whole = w.cast("decimal(19,0)") * F.col("rest_b").cast("decimal(18,0)")
        return F.call_function("div", whole, F.nullif(F.col("rest_w"), F.lit(0)).cast("decimal(19,0)"))

    part = floor_share(upto) - floor_share(upto - F.col("w"))
    return rest.withColumn("amount", F.when(F.col("full"), F.col("cap")).otherwise(part).cast("long")).drop(
        "w", "fill", "left_w", "left_b", "full", "rest_b", "rest_w")


def budgets(leaves: DataFrame, levels: list[str], weights: list[dict[str, float]], budget: int,
            max_epochs: int) -> DataFrame:
    """``amount`` of every leaf (``levels``, ``supply``): tokens to read from it."""
    rows = leaves.withColumn("cap", F.col("supply") * max_epochs)
    out = None
    for k, (name, w) in enumerate(zip(levels, weights)):
        keys = levels[:k + 1]
        nodes = rows.groupBy(*keys).agg(F.sum("cap").alias("cap"))
        if out is None:
            nodes = nodes.withColumn("budget", F.lit(budget).cast("long"))
        else:
            nodes = nodes.join(out.withColumnRenamed("amount", "budget").drop("cap"), keys[:-1])
        out = share_out(nodes, keys[:-1], name, w).select(*keys, "cap", "amount")
    return leaves.join(out.drop("cap"), levels).where("amount > 0")


def select_prefixes(light: DataFrame, leaves: DataFrame, levels: list[str], seed: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """``light`` (``doc_id``, levels, ``tokens``) read in seeded epochs up to each leaf's ``amount``."""
    cut = leaves.withColumns({
        "whole": F.floor(F.col("amount") / F.col("supply")), "rest": F.col("amount") % F.col("supply")})
    cut = cut.withColumn("whole", F.when(F.col("rest") < 0, F.col("whole") - 1).otherwise(F.col("whole")))
    rows = light.where("tokens > 0").join(cut.select(*levels, "whole", "rest"), levels)
    full = (rows.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), (F.col("whole") - 1).cast("int"))))
            .select("doc_id", *carry, *levels, "epoch", "tokens", F.col("tokens").alias("take_tokens")))
    order = seeded_hash(seed, F.col("whole"), F.col("doc_id"))
    last = (rows.where("rest > 0").withColumn("h", order)
            .withColumn("range", F.conv(F.substring("h", 1, 3), 16, 10).cast("int")))
    sums = last.groupBy(*levels, "range").agg(F.sum("tokens").alias("n"))
    until = Window.partitionBy(*levels).orderBy("range")
    sums = sums.withColumn("before", F.sum("n").over(until) - F.col("n")).select(*levels, "range", "before")
    last = last.join(sums, [*levels, "range"]).where("before < rest")
    # the ranges below the cut are whole; ordering them costs little, since each range is a window of its own
    inside = Window.partitionBy(*levels, "range").orderBy("h", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("before", F.col("before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    last = (last.where("before < rest")
            .select("doc_id", *carry, *levels, F.col("whole").cast("int").alias("epoch"), "tokens",
                    F.least(F.col("tokens"), F.col("rest") - F.col("before")).alias("take_tokens")))
    return full.union(last)


def mix_sources(docs: DataFrame, levels: dict[str, Column], weights: list[dict[str, float]],
                budget_share: float, max_epochs: int = 4, seed: int = 17, id_col: str = "doc_id",
                text_col: str = "text", budget: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document and epoch taken: the levels, ``epoch``, ``tokens`` of the document and ``take_tokens``, the
    length of the prefix to use. The budget is ``budget`` tokens, or ``budget_share`` of all tokens of the table.
    Columns named in ``carry`` come along."""
    names = list(levels)
    light = checkpointed(docs.select(
        F.col(id_col).alias("doc_id"), *carry, *[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in levels.items()],
        tokens_of(F.col(text_col)).alias("tokens")))
    supply = light.groupBy(*names).agg(F.sum("tokens").cast("long").alias("supply")).where("supply > 0")
    supply = checkpointed(supply)
    if budget is None:
        budget = (supply.agg(F.sum("supply")).first()[0] or 0) * round(budget_share * 1000) // 1000
    leaves = checkpointed(budgets(supply, names, weights, budget, max_epochs))
    return select_prefixes(light, leaves, names, seed, carry)
