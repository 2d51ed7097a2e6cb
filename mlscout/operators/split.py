"""Deterministic train/test splits and cross-validation folds."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mlscout.functions.hashing import HASH_RANGE, content_hash, key_columns, row_hash
from mlscout.functions.ordering import HASH_BITS, MAX_GROUP_ROWS, hash_bin, mark_lowest, prefix_sums
from mlscout.kinds import column
from mlscout.operators.clean import class_counts
from mlscout.operators.task import CLASSIFICATION
from mlscout.session import cut_lineage

SPLIT_SEED = 123
FOLD_SEED = 456
TRAIN_SHARE = 0.75
HASH_WIDTH = HASH_RANGE.bit_length() - 1
_PLAIN = (T.StringType, T.NumericType, T.BooleanType, T.DateType)


@dataclass
class Split:
    """``rows`` is the input plus a boolean ``is_train``."""

    rows: DataFrame
    stratified: bool
    message: str | None = None

    @property
    def train(self) -> DataFrame:
        return self.rows.filter("is_train").drop("is_train")

    @property
    def test(self) -> DataFrame:
        return self.rows.filter("NOT is_train").drop("is_train")


def split(
    df: DataFrame,
    target: str,
    task_type: str,
    prop: float = TRAIN_SHARE,
    key: str | Sequence[str] | None = None,
    seed: int = SPLIT_SEED,
    *,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> Split:
    """Mark ``prop`` of the rows as training rows by key hash.

    Regression: a hash threshold, no shuffle. Classification: exactly
    ``floor(prop * n)`` rows of every class; rows without a class are dropped. If a
    class has a single row the split falls back to the threshold.
    """
    keys = key_columns(df, key)
    message = None
    if task_type == CLASSIFICATION:
        counts = class_counts(df, target)
        if counts.filter("_n < 2").isEmpty():
            quotas = counts.withColumn("_k", F.floor(F.col("_n") * prop))
            rows = mark_lowest(
                df, target, quotas, keys, seed, "is_train", max_group_rows=max_group_rows
            )
            return Split(rows, True)
        message = "a class has a single row; the split is not stratified"
        warnings.warn(message, stacklevel=2)
    chosen = row_hash(keys, seed) < int(prop * HASH_RANGE)
    return Split(df.withColumn("is_train", chosen), False, message)


def assign_folds(
    df: DataFrame,
    v: int = 5,
    key: str | Sequence[str] | None = None,
    seed: int = FOLD_SEED,
    stratify: str | None = None,
    *,
    name: str = "fold",
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Add a column ``name`` with the fold in 0..v-1.

    Plain folds are the hash modulo ``v``. With ``stratify`` the rows of a class are dealt
    out in hash order, so its fold sizes differ by one at most, however large it is: the
    rows of a class are counted by range of the hash, running sums tell where each range
    begins, and a window numbers the rows inside. Ranges are halved until none but copies of a
    row holds more than ``max_group_rows``. Rows are shuffled once.
    """
    if not 2 <= v:
        raise ValueError("at least two folds are needed")
    keys = key_columns(df, key)
    hashed = df.withColumn("_hash", row_hash(keys, seed))
    if stratify is None:
        return hashed.withColumn(name, F.pmod(F.col("_hash"), F.lit(v)).cast("int")).drop("_hash")
    names = [column(c) for c in df.columns]
    value = column(stratify)
    if isinstance(df.schema[stratify].dataType, _PLAIN):  # a cast costs much less than JSON
        label = F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("")).alias("_class")
    else:
        label = F.to_json(F.struct(value.alias("c"))).alias("_class")
    placed = hashed.select(*names, label, "_hash", content_hash(df).alias("_content"))
    bits = HASH_BITS
    while True:
        # one row per class and range, counted once
        counts = cut_lineage(placed.groupBy("_class", _place(bits).alias("_bin")).agg(F.count("*").alias("_n")))
        if bits >= HASH_WIDTH + 64 or (counts.agg(F.max("_n")).first()[0] or 0) <= max_group_rows:
            break
        bits += HASH_BITS
    few = 2**bits if bits <= HASH_BITS else None
    starts = prefix_sums(counts, ["_class"], "_bin", ["_n"], max_group_rows=max_group_rows, group_rows=few)
    inside = Window.partitionBy("_class", "_bin").orderBy("_hash", "_content")
    nth = F.col("_n_before") + F.row_number().over(inside) - 1
    dealt = (
        placed.withColumn("_bin", _place(bits))
        .join(starts.select("_class", "_bin", "_n_before"), ["_class", "_bin"])
        .withColumn(name, F.pmod(nth, F.lit(v)).cast("int"))
    )
    return dealt.select(*[column(c) for c in df.columns if c != name], name)


def _place(bits: int) -> Column:
    """The range of a row: leading bits of its key hash, then of the hash of its content."""
    if bits <= HASH_WIDTH:
        return hash_bin(bits)
    more = F.shiftrightunsigned("_content", max(HASH_WIDTH + 64 - bits, 0))
    return F.format_string("%013x %016x", F.col("_hash"), more)


def class_shares(rows: DataFrame, target: str, part: str) -> DataFrame:
    """Rows and class share per part (``is_train`` or ``fold``): shows the stratification."""
    counts = rows.groupBy(part, column(target)).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(part)  # one row per class
    return counts.withColumn("share", F.col("n") / F.sum("n").over(whole))
