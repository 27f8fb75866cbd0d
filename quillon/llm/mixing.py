"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.shared import col, without, written

#: Seeded positions are cut into this many cells a source, by their first three hex digits.
CELL_DIGITS = 3

ADDED = ("source_size", "target", "copies")


def water_level(sources: DataFrame, budget: float, max_epochs: float) -> float | None:
    """The level at which `weight * level`, capped at `max_epochs * source_size`, sums to budget.

    Starts with every source free. Each round clamps the sources whose share exceeds
    their cap and shares what is left among the others by weight; the level only rises, so
    a clamped source stays clamped. Ends when a round clamps no more. None: every source
    is at its cap, whatever is left of the budget.
    """
    cap = F.col("source_size") * max_epochs
    clamped, level = -1, 0.0
    while True:
        over = cap <= F.col("weight") * level
        now = sources.agg(
            F.count_if(over).alias("n"),
            F.sum(F.when(over, cap).otherwise(0.0)).alias("words"),
            F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("weight"),
        ).first()
        if now.n == clamped:
            return level
        if not now.weight:
            return None
        clamped, level = now.n, (budget - now.words) / now.weight


def mix_sources(
    docs: DataFrame,
    weights: DataFrame,
    *,
    key: Sequence[str],
    seed: int = 42,
    max_epochs: float = 3.0,
    share: float = 1.0,
) -> DataFrame:
    """How often a mix takes each row of `docs` (columns `source`, `size` and `key`).

    `weights` has (source, weight), weights above 0; sources are matched with null equal
    to null, and a source without a weight is not taken. The mix holds `share` of all
    sizes. Each source gets a part of it by weight, but at most `max_epochs` times its own
    size; what is cut off is shared among the others by weight, again and again until none
    is above.

    Adds `source_size`, `target` (of the row's source) and `copies`: every row comes as
    many whole times as the target holds the source, and the rest of the target is filled
    with rows in the order of md5(seed and key) until it is met to within half a row. Rows
    are taken whole. Columns of these names in `docs` are replaced.

    Size null counts as 0. Rows with equal keys are placed by size, so equal rows are
    interchangeable. A source of size 0 has target 0 and is not taken; an empty table
    gives an empty result.

    A hot source is never gathered: sizes are summed on the map side by source and cell of
    the seeded order, and only the one cell per source in which the target ends is sorted.
    """
    docs = without(docs, ADDED)
    names = [col(c) for c in docs.columns]
    place = F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *[col(k).cast("string") for k in key]))
    rows = docs.select(
        F.struct(*names).alias("row"),
        col("source").alias("source"),
        F.coalesce(col("size").cast("bigint"), F.lit(0)).alias("size"),
        place.alias("place"),
    ).withColumn("cell", F.substring("place", 1, CELL_DIGITS))

    cells = written(rows.groupBy("source", "cell").agg(F.sum("size").alias("words")))
    plan = written(_plan(cells, weights, max_epochs, share))
    met = rows.join(plan, rows.source.eqNullSafe(plan.planned), "left").drop("planned")

    whole = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0))
    before_edge = F.coalesce(F.col("cell") < F.col("edge"), F.lit(False))
    at_edge = F.coalesce(F.col("cell") == F.col("edge"), F.lit(False))

    def finish(df: DataFrame, extra: Column) -> DataFrame:
        return df.select(
            "row.*",
            F.coalesce("source_size", F.lit(0)).cast("bigint").alias("source_size"),
            F.coalesce("target", F.lit(0.0)).alias("target"),
            (whole + F.when(extra, 1).otherwise(0)).cast("int").alias("copies"),
        )

    order = Window.partitionBy("source").orderBy("place", "size")
    run = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edge = met.where(at_edge).withColumn("run", run)
    middle = F.col("before") + F.col("run") - F.col("size") / 2
    return finish(met.where(~at_edge), before_edge).unionByName(
        finish(edge, middle <= F.col("rest"))
    )


def _plan(cells: DataFrame, weights: DataFrame, max_epochs: float, share: float) -> DataFrame:
    """Per source: size, target, `rest` (what whole copies leave of it), and the cell, with
    the words before it, in which the rest ends."""
    sums = cells.groupBy("source").agg(F.sum("words").alias("source_size"))
    given = weights.select(col("source").alias("given"), col("weight").cast("double").alias("weight"))
    sources = written(sums.join(given, sums.source.eqNullSafe(given.given)).drop("given"))
    total = cells.agg(F.sum("words")).first()[0] or 0
    level = water_level(sources, total * share, max_epochs)
    cap = F.col("source_size") * max_epochs
    target = cap if level is None else F.least(cap, F.col("weight") * level)
    targets = sources.withColumn("target", target).select(
        F.col("source").alias("planned"),
        "source_size",
        "target",
        F.when(
            F.col("source_size") > 0,
            F.col("target") - F.floor(F.col("target") / F.col("source_size")) * F.col("source_size"),
        ).alias("rest"),
    )
    order = Window.partitionBy("source").orderBy("cell")
    upto = cells.withColumn("upto", F.sum("words").over(order))
    edges = (
        upto.join(targets, upto.source.eqNullSafe(targets.planned))
        .where((F.col("rest") > 0) & (F.col("upto") >= F.col("rest")))
        .groupBy(F.col("source").alias("edged"))
        .agg(F.min(F.struct("cell", (F.col("upto") - F.col("words")).alias("before"))).alias("e"))
    )
    return targets.join(edges, targets.planned.eqNullSafe(edges.edged), "left").select(
        "planned", "source_size", "target", "rest", F.col("e.cell").alias("edge"), "e.before"
    )
