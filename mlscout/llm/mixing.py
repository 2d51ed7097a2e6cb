"""Mixing sources to target weights with hash-threshold histograms.

A source's target is its share of the budget by weight, at most ``max_epochs`` times its own
size. It is met by whole epochs of every document and one partial epoch: the documents whose
hash lies below a threshold. The threshold is found without sorting: sizes are summed by
source and the leading bits of the hash, the bucket in which the running sum crosses the
budget is the boundary, and only that bucket is summed by the next bits, until the hash is
used up. A pass shuffles one row per (source, bucket) and task, whatever the rows.

The hash is that of id and text, so rows with null or repeated ids are decided apart unless
their texts are equal too; rows equal in both are taken together. Null texts have size 0, null
sources are a source of their own (the last one), very long texts are counted whole, a table
without rows gives none. Columns besides key, source, text and those to carry are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mlscout.llm.common import stored

HASH_BITS = 52
LEVEL_BITS = 13
WORD = r"[^\x20\x09-\x0D]+"


def word_count(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(f"`{column}`"), F.lit(WORD)), F.lit(0)).cast("long")


def hash52(key: Column, text: Column) -> Column:
    """52 bits of the MD5 of a key and a text, the same in every engine."""
    empty = F.lit("")
    both = F.concat(
        F.coalesce(key.cast("string"), empty), F.lit(":"), F.md5(F.coalesce(text.cast("string"), empty))
    )
    return F.conv(F.substring(F.md5(both), 1, 13), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Column, budget: float, max_epochs: int) -> DataFrame:
    """Add ``target`` to one row per source (source, source_size).

    Each target is min(max_epochs * size, level * weight). The level follows from the sources
    in order of the level at which they stop: those below it stop, the rest share what is
    left. ``weights`` may use ``position``, the place of the source by code point, null last.
    The windows run over sources, not over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("position", F.row_number().over(by_name)).withColumn("weight", weights)
    ranked = ranked.withColumn("stop", F.lit(max_epochs) * F.col("source_size"))
    ranked = ranked.withColumn("_at", F.col("stop") / F.col("weight"))
    order = Window.orderBy("_at", "position")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(float(budget))
    left = total - F.coalesce(F.sum("stop").over(before), F.lit(0))
    ranked = ranked.withColumn("_level", left / F.sum("weight").over(rest))
    # the first source that does not stop tells the level
    level = F.min(F.when(F.col("_level") < F.col("_at"), F.struct("_at", "position", "_level"))).over(
        everything
    )["_level"]
    return ranked.withColumn(
        "target",
        F.least(F.col("stop").cast("double"), F.coalesce(level * F.col("weight"), F.col("stop"))),
    ).select("source", "source_size", "weight", "target")


def thresholds(docs: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per source the ``bound`` at which rows with ``_hash < bound`` come nearest the budget.

    ``docs`` has source, size and _hash, ``budgets`` has source and part. Every level keeps
    the running sum before the boundary bucket, so budgets that grow give nested choices.
    """
    state = budgets.select(
        F.col("source").alias("_source"),
        F.col("part"),
        F.lit(0).cast("long").alias("_prefix"),
        F.lit(0).cast("long").alias("_used"),
    )
    taken = HASH_BITS
    rows = docs.filter("size > 0").select("source", "size", "_hash")
    while taken > 0:
        taken -= LEVEL_BITS
        inside = rows.join(state, rows["source"].eqNullSafe(state["_source"])).filter(
            F.shiftright("_hash", taken + LEVEL_BITS) == F.col("_prefix")
        )
        sums = inside.groupBy("_source", "part", "_used", F.shiftright("_hash", taken).alias("_b")).agg(
            F.sum("size").alias("_size")
        )
        upto = Window.partitionBy("_source").orderBy("_b")  # at most 2 ** LEVEL_BITS rows each
        running = sums.withColumn("_end", F.col("_used") + F.sum("_size").over(upto))
        # the first bucket that does not fit; where all fit the prefix leaves the range
        crossing = running.groupBy("_source", "part").agg(
            F.min(
                F.when(
                    F.col("_end") > F.col("part"),
                    F.struct(F.col("_b"), (F.col("_end") - F.col("_size")).alias("_used"), "_end"),
                )
            ).alias("_next"),
            F.max("_b").alias("_last"),
            F.max("_end").alias("_all"),
        )
        state = stored(
            crossing.select(
                "_source",
                "part",
                F.coalesce(F.col("_next._b"), F.col("_last") + 1).alias("_prefix"),
                F.coalesce(F.col("_next._used"), F.col("_all")).alias("_used"),
                F.col("_next").isNull().alias("_whole"),
                F.col("_next._end").alias("_end"),
            ),
            "mix",
        )
        done = state.filter("_whole").select("_source", F.shiftleft("_prefix", taken).alias("bound"))
        found = done if taken == HASH_BITS - LEVEL_BITS else found.unionByName(done)
        if not taken:
            # the document at the boundary is taken if that comes nearer
            over = F.col("_end") - F.col("part") < F.col("part") - F.col("_used")
            last = (F.col("_prefix") + over.cast("long")).alias("bound")
            return found.unionByName(state.filter("NOT _whole").select("_source", last))
        state = state.filter("NOT _whole").drop("_whole", "_end")


def mix(
    docs: DataFrame,
    weights: Column | None = None,
    *,
    key: str = "doc_id",
    budget: float = 1.0,
    max_epochs: int = 3,
    carry: list[str] | None = None,
) -> DataFrame:
    """Per document its size, its source's size and target, and ``copies`` and ``taken`` words.

    ``carry`` names further columns to keep. ``weights`` defaults to 1, 2, 3 repeating.
    """
    if weights is None:
        weights = F.pmod(F.col("position") - 1, F.lit(3)) + 1
    keep = [c for c in carry or [] if c not in (key, "source")]
    slim = docs.select(
        F.col(f"`{key}`").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        *[F.col(f"`{c}`") for c in keep],
        word_count().alias("size"),
        hash52(F.col(f"`{key}`"), F.col("text")).alias("_hash"),
    )
    if not keep:
        slim = stored(slim, "mix")  # counted once, read by every pass
    narrow = slim.select("source", "size", "_hash")
    if keep:
        narrow = stored(narrow, "mix")
    plan = targets(
        narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, max_epochs
    )
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = stored(
        plan.withColumn("epochs", whole.cast("int")).withColumn(
            "part", F.col("target") - F.col("epochs") * F.col("source_size")
        ),
        "mix",
    )
    bounds = thresholds(narrow, plan.filter("part > 0").select("source", "part"))
    plan = plan.join(bounds, plan["source"].eqNullSafe(bounds["_source"]), "left").select(
        plan["source"].alias("_source"), "source_size", "target", "epochs", "bound"
    )
    # what is carried may be whole texts: they stay where they are
    joined = slim.join(F.broadcast(plan) if keep else plan, slim["source"].eqNullSafe(plan["_source"]))
    copies = F.col("epochs") + F.coalesce((F.col("_hash") < F.col("bound")).cast("int"), F.lit(0))
    return joined.withColumn("copies", copies).select(
        "doc_id",
        "source",
        *keep,
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
    )
