"""Table readers. Every reader returns a lazy, partitioned DataFrame."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Candidate delimiters, ties go to the earlier one.
DELIMITERS = ["\t", ",", ";", "|"]
SNIFFED_LINES = 5

_TEXT_FORMATS = {"csv": ",", "tsv": "\t"}
_STAT_FORMATS = ["sas7bdat", "xpt", "dta"]
SUPPORTED = ["csv", "tsv", "txt", "parquet", *_STAT_FORMATS]


def resolve_format(path: str, name: str | None = None) -> str:
    """Format from the extension; the original file name wins over the path."""
    ext = ""
    for candidate in (name, path):
        if candidate and not ext:
            ext = os.path.splitext(candidate)[1].lstrip(".").lower()
    if not ext:
        raise ValueError("cannot tell the file format: there is no file extension")
    if ext not in SUPPORTED:
        raise ValueError(f"unsupported file format '.{ext}'; use one of {', '.join(SUPPORTED)}")
    return ext


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    name: str | None = None,
    schema: T.StructType | str | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """Read a table by format. With ``schema`` no inference pass over the text is made.

    ``multi_line`` keeps quoted line breaks and reads each text file in one task; turn
    it off for large files without such breaks, which Spark then splits.
    """
    fmt = fmt or resolve_format(path, name)
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt in _TEXT_FORMATS:
        return _read_delimited(spark, path, _TEXT_FORMATS[fmt], schema, multi_line)
    if fmt == "txt":
        delimiter = sniff_delimiter(spark, path)
        if delimiter is None:
            return _read_whitespace(spark, path, schema)
        return _read_delimited(spark, path, delimiter, schema, multi_line)
    if fmt in _STAT_FORMATS:
        return read_stat_files(spark, path, schema)
    raise ValueError(f"unsupported format '{fmt}'")


def _read_delimited(
    spark: SparkSession,
    path: str,
    delimiter: str,
    schema: T.StructType | str | None,
    multi_line: bool,
) -> DataFrame:
    reader = spark.read.options(
        header=True, sep=delimiter, quote='"', escape='"', multiLine=multi_line, nullValue="NA"
    )
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def sniff_delimiter(spark: SparkSession, path: str) -> str | None:
    """Most frequent delimiter in the first lines; None when there is none (whitespace)."""
    lines = [r.value for r in spark.read.text(path).limit(SNIFFED_LINES).collect()]
    if not lines:
        raise ValueError(f"'{path}' is empty")
    counts = {d: sum(line.count(d) for line in lines) for d in DELIMITERS}
    best = max(counts.values())
    if best == 0:
        return None
    return next(d for d in DELIMITERS if counts[d] == best)


def _read_whitespace(
    spark: SparkSession, path: str, schema: T.StructType | str | None
) -> DataFrame:
    """Blank-separated text: runs of blanks become one comma-free field separator."""
    names = spark.read.text(path).first().value.split()
    fields = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )
    # the first line of each file, by its place: a data row may look like it
    first = lines.filter("_block = 0").groupBy("_file").agg(F.min("_line").alias("_line"))
    rest = lines.join(first, ["_file", "_line"], "left_anti")
    body = rest.filter(F.trim("value") != "").select(
        *[F.try_element_at(fields, F.lit(i + 1)).alias(n) for i, n in enumerate(names)]
    )
    body = body.select(*[F.nullif(F.col(n), F.lit("NA")).alias(n) for n in names])
    if schema is None:
        schema = _infer_text_types(body)
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    return body.select(*[F.col(n).cast(schema[n].dataType).alias(n) for n in names])


def _infer_text_types(body: DataFrame) -> T.StructType:
    """Narrowest of int, double and string every value of a column casts to: one aggregate."""
    checks = []
    for n in body.columns:
        value = F.col(n)
        for kind in ("int", "double"):
            lost = value.isNotNull() & value.try_cast(kind).isNull()
            checks.append(F.count_if(lost).alias(f"{n}:{kind}"))
    row = body.agg(*checks).first().asDict()
    fields = []
    for n in body.columns:
        kind = T.StringType()
        if row[f"{n}:double"] == 0:
            kind = T.IntegerType() if row[f"{n}:int"] == 0 else T.DoubleType()
        fields.append(T.StructField(n, kind))
    return T.StructType(fields)


def read_stat_files(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """SAS (sas7bdat, xpt) and Stata (dta) files of a folder or glob, one task per file.

    Each file is decoded by pandas in the task that reads it and yields plain values:
    value labels are not applied. Without ``schema`` the first file names the columns.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    if schema is None:
        schema = _stat_schema(files)
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    names = schema.names
    text = {f.name for f in schema if isinstance(f.dataType, T.StringType)}

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import pandas as pd

        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                source = io.BytesIO(content)
                if file.lower().endswith(".dta"):
                    chunks = pd.read_stata(source, convert_categoricals=False, chunksize=50_000)
                else:
                    kind = "xport" if file.lower().endswith(".xpt") else "sas7bdat"
                    chunks = pd.read_sas(source, format=kind, encoding="utf-8", chunksize=50_000)
                for chunk in chunks:
                    for c in names:
                        if c in text:
                            chunk[c] = chunk[c].astype(object).where(chunk[c].notna(), None)
                    yield chunk[names]

    return files.mapInPandas(decode, schema)


def _stat_schema(files: DataFrame) -> T.StructType:
    """Column names and types of one file, read from its first rows."""

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import pandas as pd

        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                source = io.BytesIO(content)
                if file.lower().endswith(".dta"):
                    reader = pd.read_stata(source, convert_categoricals=False, chunksize=100)
                else:
                    kind = "xport" if file.lower().endswith(".xpt") else "sas7bdat"
                    reader = pd.read_sas(source, format=kind, encoding="utf-8", chunksize=100)
                head = next(iter(reader))
                kinds = []
                for c in head.columns:
                    if pd.api.types.is_datetime64_any_dtype(head[c]):
                        kinds.append("timestamp")
                    elif pd.api.types.is_numeric_dtype(head[c]):
                        kinds.append("double")
                    else:
                        kinds.append("string")
                yield pd.DataFrame({"name": [str(c) for c in head.columns], "kind": kinds})

    rows = files.limit(1).mapInPandas(describe, "name string, kind string").collect()
    return T.StructType.fromDDL(", ".join(f"`{r['name']}` {r.kind}" for r in rows))


def preview(df: DataFrame, n: int = 100, order_by: str | None = None) -> DataFrame:
    """The first ``n`` rows; give ``order_by`` for a repeatable choice (top-n, not a sort)."""
    return (df.orderBy(order_by) if order_by else df).limit(n)
