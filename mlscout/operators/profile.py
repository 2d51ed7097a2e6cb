"""Column profiles: structure, types, missing share, numeric and categorical summaries."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mlscout.functions.counts import top_values, value_counts
from mlscout.functions.ordering import exact_quantiles
from mlscout.kinds import (
    CATEGORICAL,
    NUMERIC,
    column,
    columns_of,
    drop_nested,
    finite_double,
    infinite,
    is_floating,
    is_integral,
    missing,
    present_double,
)
from mlscout.operators.gram import pair_correlations

MAX_UNIQUE = 10_000


@dataclass
class Profile:
    """Five small tables keyed by ``column``; ``missing`` drives the issue rules."""

    structure: DataFrame
    types: DataFrame
    missing: DataFrame
    numeric: DataFrame | None
    categorical: DataFrame | None
    top_values: DataFrame | None
    dropped_columns: list[str] = field(default_factory=list)


def profile(df: DataFrame, *, exact: bool = True, max_unique: int = MAX_UNIQUE) -> Profile:
    if df.isEmpty():
        raise ValueError("the table is empty")
    df, nested = drop_nested(df)
    has_text = bool(columns_of(df, CATEGORICAL))
    return Profile(
        structure=profile_structure(df),
        types=profile_types(df),
        missing=profile_missing(df),
        numeric=profile_numeric(df, exact=exact) if columns_of(df, NUMERIC) else None,
        categorical=profile_categorical(df, exact=exact) if has_text else None,
        top_values=profile_top_values(df, max_unique=max_unique) if has_text else None,
        dropped_columns=nested,
    )


def _tall(df: DataFrame, entries: list[Column], aggregates: list[Column]) -> DataFrame:
    """One global aggregate, then one output row per entry."""
    return df.agg(*aggregates).select(F.inline(F.array(*entries)))


def profile_structure(df: DataFrame) -> DataFrame:
    """Row count, column count and names, after nested columns are dropped."""
    df, _ = drop_nested(df)
    return df.agg(F.count("*").alias("n_rows")).select(
        "n_rows",
        F.lit(len(df.columns)).alias("n_cols"),
        F.array(*[F.lit(c) for c in df.columns]).alias("col_names"),
    )


def profile_types(df: DataFrame) -> DataFrame:
    df, _ = drop_nested(df)
    return df.sparkSession.createDataFrame(
        [(i, name, kind) for i, (name, kind) in enumerate(df.dtypes)],
        "position int, column string, type string",
    )


def profile_missing(df: DataFrame) -> DataFrame:
    """Missing count and percent of every column, from one aggregate."""
    df, _ = drop_nested(df)
    if not df.columns:
        raise ValueError("no column left to profile")
    aggregates = [F.count("*").alias("n")] + [
        F.count_if(missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)
    ]
    entries = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(c).alias("column"),
            F.col(f"m{i}").alias("n_missing"),
            F.try_divide(F.col(f"m{i}") * 100.0, F.col("n")).alias("pct_missing"),
        )
        for i, c in enumerate(df.columns)
    ]
    return _tall(df, entries, aggregates)


def count_unique(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, n_unique)`` over finite values, one shuffle on (column, value).

    Columns are unpivoted by physical type, so large integer keys are not squeezed
    through a double, and no ``Expand`` over all column slots is planned.
    """
    families: dict[str, list[str]] = {"bigint": [], "double": [], "string": []}
    for c in columns:
        data_type = df.schema[c].dataType
        if is_integral(data_type):
            families["bigint"].append(c)
        elif is_floating(data_type):
            families["double"].append(c)
        else:
            families["string"].append(c)
    parts = []
    for cast, names in families.items():
        if not names:
            continue
        entries = []
        for c in names:
            value = finite_double(df, c) if cast == "double" else column(c).cast(cast)
            entries.append(F.struct(F.lit(c).alias("column"), value.alias("value")))
        parts.append(
            df.select(F.inline(F.array(*entries)))
            .groupBy("column", "value")
            .agg(F.count("*").alias("n"))
            .groupBy("column")
            .agg(F.count("value").alias("n_unique"))
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def profile_numeric(df: DataFrame, *, exact: bool = True) -> DataFrame:
    """Mean, median, sd, min, max, distinct and infinite counts of numeric columns.

    Any infinite value blanks mean, sd, min and max; median and the distinct count
    use finite values. ``exact=False`` swaps median and distinct count for sketches,
    which makes the whole summary one aggregate without a value shuffle.
    """
    names = columns_of(df, NUMERIC)
    if not names:
        raise ValueError("no numeric column")
    aggregates: list[Column] = []
    entries: list[Column] = []
    medians = exact_quantiles(df, names, [0.5]) if exact else {}
    for i, c in enumerate(names):
        value = finite_double(df, c)
        aggregates += [
            F.count_if(infinite(df, c)).alias(f"inf{i}"),
            F.avg(value).alias(f"avg{i}"),
            F.stddev_samp(value).alias(f"sd{i}"),
            F.min(value).alias(f"min{i}"),
            F.max(value).alias(f"max{i}"),
        ]
        if not exact:
            aggregates += [
                F.percentile_approx(value, 0.5, 10_000).alias(f"med{i}"),
                F.approx_count_distinct(value).alias(f"uni{i}"),
            ]
        clean = F.col(f"inf{i}") == 0
        fields = [
            F.lit(i).alias("position"),
            F.lit(c).alias("column"),
            F.when(clean, F.col(f"avg{i}")).alias("mean"),
            (F.lit(medians[c][0]).cast("double") if exact else F.col(f"med{i}")).alias("median"),
            F.when(clean, F.col(f"sd{i}")).alias("sd"),
            F.when(clean, F.col(f"min{i}")).alias("min"),
            F.when(clean, F.col(f"max{i}")).alias("max"),
        ]
        if not exact:
            fields.append(F.col(f"uni{i}").alias("n_unique"))
        fields.append(F.col(f"inf{i}").alias("n_infinite"))
        entries.append(F.struct(*fields))
    summary = _tall(df, entries, aggregates)
    if not exact:
        return summary
    order = ["position", "column", "mean", "median", "sd", "min", "max", "n_unique", "n_infinite"]
    return summary.join(count_unique(df, names), "column", "left").select(*order)


def profile_categorical(df: DataFrame, *, exact: bool = True) -> DataFrame:
    """Distinct values per text column; a missing value counts as one value."""
    names = columns_of(df, CATEGORICAL)
    if not names:
        raise ValueError("no categorical column")
    if exact:
        return (
            value_counts(df, names)
            .groupBy("position", "column")
            .agg(F.count("*").alias("n_unique"))
        )
    aggregates = []
    entries = []
    for i, c in enumerate(names):
        aggregates += [
            F.approx_count_distinct(column(c)).alias(f"u{i}"),
            F.max(column(c).isNull().cast("int")).alias(f"m{i}"),
        ]
        entries.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(c).alias("column"),
                (F.col(f"u{i}") + F.col(f"m{i}")).alias("n_unique"),
            )
        )
    return _tall(df, entries, aggregates)


def profile_top_values(df: DataFrame, k: int = 5, max_unique: int = MAX_UNIQUE) -> DataFrame:
    """The ``k`` most frequent values of each text column with at most ``max_unique`` values.

    Any other column has one row without rank, whose value says why: it has no values, or too
    many, whose number is then given.
    """
    names = columns_of(df, CATEGORICAL)
    if not names:
        raise ValueError("no categorical column")
    counts = value_counts(df, names)
    # both uses read n, so that they share one shuffle of the counts
    sizes = counts.groupBy("position", "column").agg(
        F.count("*").alias("n_unique"), F.sum("n").alias("rows"), F.count("value").alias("n_values")
    )
    allowed = sizes.filter((F.col("n_unique") <= max_unique) & (F.col("rows") > 0)).select("column")
    shown = (
        top_values(counts, k)
        .join(allowed, "column", "left_semi")
        .select("position", "column", "rank", "value", "n")
    )
    many = F.concat(F.lit("too many values to show: "), F.col("n_unique").cast("string"))
    told = sizes.filter((F.col("n_unique") > max_unique) | (F.col("n_values") == 0)).select(
        "position",
        "column",
        F.lit(None).cast("int").alias("rank"),
        F.when(F.col("n_values") == 0, F.lit("no values")).otherwise(many).alias("value"),
        F.lit(None).cast("long").alias("n"),
    )
    return shown.unionByName(told)


def avg_missing(missing_table: DataFrame) -> DataFrame:
    """Mean missing percent over the columns and whether it is above 20."""
    return missing_table.agg(F.avg("pct_missing").alias("avg_pct_missing")).withColumn(
        "flagged", F.col("avg_pct_missing") > 20
    )


def cleaning_summary(df: DataFrame) -> DataFrame:
    """Total missing cells and the number of numeric and other columns."""
    flat, _ = drop_nested(df)
    numeric = len(columns_of(flat, NUMERIC))
    return profile_missing(flat).agg(F.sum("n_missing").alias("missing_cells")).select(
        "missing_cells",
        F.lit(numeric).alias("n_numeric"),
        F.lit(len(flat.columns) - numeric).alias("n_categorical"),
    )


def round_numeric(df: DataFrame, digits: int = 3) -> DataFrame:
    """Round every non-integral numeric column, for display."""
    shown = set(columns_of(df, NUMERIC))
    return df.select(
        *[
            F.round(column(f.name), digits).alias(f.name)
            if f.name in shown and not is_integral(f.dataType)
            else column(f.name)
            for f in df.schema
        ]
    )


def iqr_fences(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float] | None]:
    """Tukey fences Q1 - 1.5 IQR and Q3 + 1.5 IQR; None for an all-missing column."""
    fences = {}
    for c, (q1, q3) in exact_quantiles(df, columns, [0.25, 0.75], keep_infinite=True).items():
        spread = None if q1 is None else q3 - q1
        fences[c] = None if spread is None else (q1 - 1.5 * spread, q3 + 1.5 * spread)
    return fences


def profile_outliers(df: DataFrame) -> DataFrame:
    """Rows outside the Tukey fences, per numeric column."""
    names = columns_of(df, NUMERIC)
    fences = iqr_fences(df, names)
    aggregates = []
    entries = []
    for i, c in enumerate(names):
        low, high = fences[c] or (None, None)
        value = present_double(df, c)
        outside = (value < F.lit(low).cast("double")) | (value > F.lit(high).cast("double"))
        aggregates.append(F.count_if(outside).alias(f"o{i}"))
        entries.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(c).alias("column"),
                F.lit(low).cast("double").alias("lower"),
                F.lit(high).cast("double").alias("upper"),
                F.col(f"o{i}").alias("n_outliers"),
            )
        )
    return _tall(df, entries, aggregates)


def profile_correlations(df: DataFrame) -> DataFrame:
    """Pearson r of every pair of numeric columns over rows where both are finite.

    A constant side gives NULL. All pairs come from one scan of the table.
    """
    names = columns_of(df, NUMERIC)
    if len(names) < 2:
        raise ValueError("needs at least two numeric columns")
    values = df.select(*[finite_double(df, c).alias(f"c{i}") for i, c in enumerate(names)])
    return pair_correlations(values, names).drop("n")


def profile_histogram(df: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-width histogram of the finite values of every numeric column."""
    names = columns_of(df, NUMERIC)
    limits = df.agg(
        *[
            f(finite_double(df, c)).alias(f"{p}{i}")
            for i, c in enumerate(names)
            for f, p in ((F.min, "lo"), (F.max, "hi"))
        ]
    ).first()
    entries = []
    edges = []
    for i, c in enumerate(names):
        low, high = limits[f"lo{i}"], limits[f"hi{i}"]
        if low is None:
            continue
        value = finite_double(df, c)
        if low == high:
            slot = F.when(value.isNotNull(), F.lit(1))
        else:
            slot = F.least(
                F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins)
            )
        entries.append(F.struct(F.lit(i).alias("position"), slot.cast("int").alias("bin")))
        edges.append((i, c, low, (high - low) / bins))
    counted = (
        df.select(F.inline(F.array(*entries)))
        .filter("bin IS NOT NULL")
        .groupBy("position", "bin")
        .agg(F.count("*").alias("n"))
    )
    # one row per numeric column
    edge_table = df.sparkSession.createDataFrame(
        edges, "position int, column string, low double, width double"
    )
    return counted.join(F.broadcast(edge_table), "position").select(
        "position",
        "column",
        "bin",
        (F.col("low") + (F.col("bin") - 1) * F.col("width")).alias("bin_start"),
        (F.col("low") + F.col("bin") * F.col("width")).alias("bin_end"),
        "n",
    )
