"""Readers and writers. Schemas are declared, or inferred from all rows of a CSV file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plurality.functions import col
from plurality.operators.indexing import number_rows, row_ids
from plurality.schema import CSV_SCHEMA, FORM_SCHEMA, VOTE_SCHEMA
from plurality.sources import borders

# How the CSV files are written (quotes doubled, NA for missing,
# blanks around text kept).
_CSV_FORMAT = {
    "header": True,
    "nullValue": "NA",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def read_json(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType = FORM_SCHEMA,
    array: bool = False,
) -> DataFrame:
    """JSON records, one per line, or with ``array`` one array of objects per file.

    Either form is read by as many tasks as its files have splits, wherever their line
    breaks are. Records that break the schema fail, and so does text outside the array
    or anything but objects in it.
    """
    if not array:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    found = borders.json_records(spark, path)
    text, first = F.col("text"), F.col("record") == 0
    opening = F.when(first, r"^\uFEFF?\s*\[\s*").otherwise(r"^\s*,\s*")
    body = F.regexp_replace(text, opening, F.lit(""))
    fits = (body != text) & body.startswith("{")
    closing = text.rlike(r"^\s*\]\s*$") & ~first | text.rlike(r"^\uFEFF?\s*\[\s*\]\s*$") & first
    row = F.from_json(body, schema, {"mode": "FAILFAST"})
    nothing = F.array().cast(T.ArrayType(schema))
    broken = F.raise_error(F.concat(F.lit("not an array of objects: "), "file")).cast(
        T.ArrayType(schema)
    )
    rows = (
        F.when(F.col("complete") & fits, F.array(row))
        .when(~F.col("complete") & closing, nothing)
        .otherwise(broken)
    )
    return found.select(F.inline(rows))


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | None = CSV_SCHEMA,
    multiline: bool = False,
    mode: str = "FAILFAST",
) -> DataFrame:
    """CSV with a header line; columns are found by their names in it.

    The file may order them differently and hold others; a declared column that
    it lacks is an error. One unnamed column may be declared as ``_c<place>``.
    Files whose headers differ from each other fail. ``multiline`` allows line breaks
    inside quotes, and finds the records' borders first. Lines that break the schema
    fail; with ``mode`` "PERMISSIVE" what cannot be read becomes NULL. Without a
    ``schema`` all rows are read once to find one (see :func:`inferred_types`).
    """
    reader = spark.read.options(**_CSV_FORMAT).options(multiLine=multiline, mode=mode)
    header = spark.read.options(**{**_CSV_FORMAT, "header": False}, multiLine=multiline)
    found = header.csv(path).first()
    declared = [] if schema is None else schema.fieldNames()
    titles = declared if found is None else list(found)
    names = [title or f"_c{place}" for place, title in enumerate(titles)]
    if schema is None:
        texts = T.StructType([T.StructField(name, T.StringType()) for name in names])
        return inferred_types(read_csv(spark, path, texts, multiline, mode))
    missing = [name for name in schema.fieldNames() if name not in names]
    if missing:
        raise ValueError(f"the CSV header has no column {', '.join(missing)}")
    kinds = {field.name: field.dataType for field in schema.fields}
    in_file = T.StructType(
        [
            # Spark sees an empty header cell without quotes as the text for missing.
            T.StructField(
                _CSV_FORMAT["nullValue"] if title is None else title,
                kinds.get(name, T.StringType()),
            )
            for title, name in zip(titles, names)
        ]
    )
    if multiline:
        rows = _quoted_rows(spark, path, in_file, titles, mode)
    else:
        # Without enforceSchema every file's own header is compared with the schema.
        rows = reader.schema(in_file).option("enforceSchema", False).csv(path)
    named = rows.toDF(*names)
    return named.select(*[col(name) for name in schema.fieldNames()])


def _quoted_rows(
    spark: SparkSession,
    path: str | list[str],
    in_file: T.StructType,
    titles: Sequence[str | None],
    mode: str,
) -> DataFrame:
    """The rows of CSV files with line breaks inside quotes, read by many tasks."""
    options = {k: str(v) for k, v in _CSV_FORMAT.items() if k != "header"}
    found = borders.csv_records(spark, path)
    # A line break is one character, as in Spark's own reader.
    text = F.replace(F.regexp_replace("text", "\r$", ""), F.lit("\r\n"), F.lit("\n"))
    records = found.select("file", (F.col("record") == 0).alias("first"), text.alias("text"))
    cells = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(titles))])
    header = F.from_csv("text", cells.simpleString()[7:-1].replace(":", " "), options)
    agrees = F.lit(True)
    for i, title in enumerate(titles):
        agrees = agrees & header[f"_{i}"].eqNullSafe(F.lit(title))
    differs = F.raise_error(F.concat(F.lit("the header differs in "), "file")).cast("boolean")
    is_row = F.when(F.col("first"), F.when(agrees, False).otherwise(differs)).otherwise(
        F.col("text") != ""
    )
    kinds = ", ".join(f"_{i} {f.dataType.simpleString()}" for i, f in enumerate(in_file.fields))
    row = F.from_csv("text", kinds, options | {"mode": mode})
    none = F.array().cast(f"array<struct<{kinds.replace(' ', ':').replace(',:', ',')}>>")
    # Through an array, so that no later filter parses a record again.
    return records.select(F.inline(F.when(is_row, F.array(row)).otherwise(none)))


# The texts of logical columns.
_LOGICAL = ("T", "F", "TRUE", "FALSE", "true", "false")
_WHOLE = r"^[+-]?[0-9]+$"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def inferred_types(texts: DataFrame) -> DataFrame:
    """Text columns as logical, integer, double or text, whichever holds all values.

    Every row counts, in one aggregate: a column's type is the least that holds all its
    values, and partial types of tasks merge. Blank and missing values fit every type;
    a column with no other values is logical. A whole number beyond 64 bits is a double.
    """
    found = texts.agg(
        *[
            F.max(F.when(kind, 1).otherwise(0)).alias(f"{name}_{i}")
            for i, column in enumerate(texts.columns)
            for name, kind in _kinds(F.trim(col(column))).items()
        ]
    ).first()
    return texts.select(
        *[_typed(col(c), *[found[f"{k}_{i}"] for k in _KINDS]).alias(c)
          for i, c in enumerate(texts.columns)]
    )


_KINDS = ("logical", "whole", "number", "text")


def _kinds(value: Column) -> dict[str, Column]:
    """To which type's values a text belongs; a blank one to none."""
    logical = value.isin(*_LOGICAL)
    whole = value.rlike(_WHOLE) & value.try_cast("bigint").isNotNull()
    number = value.rlike(_NUMBER) & ~whole
    blank = value == ""
    return dict(zip(_KINDS, (logical, whole, number, ~(logical | whole | number | blank))))


def _typed(value: Column, logical: int | None, whole: int, number: int, text: int) -> Column:
    """A text column in the least type that holds the kinds found in it."""
    filled = F.when(F.trim(value) != "", F.trim(value))
    if text or logical and (whole or number):
        return value
    if number:
        return filled.cast("double")
    if whole:
        return filled.cast("bigint")
    return F.when(filled.isNotNull(), filled.isin("T", "TRUE", "true"))


def read_table(
    spark: SparkSession, path: str | list[str], schema: T.StructType | None = VOTE_SCHEMA
) -> DataFrame:
    """A saved (Parquet) table; its own schema is used where none is given.

    A declared column that the table lacks is an error, not a column of NULLs.
    """
    paths = [path] if isinstance(path, str) else path
    if schema is None:
        return spark.read.parquet(*paths)
    saved = spark.read.parquet(*paths).columns
    missing = [name for name in schema.fieldNames() if name not in saved]
    if missing:
        raise ValueError(f"the saved table has no column {', '.join(missing)}")
    return spark.read.schema(schema).parquet(*paths)


def write_csv(
    df: DataFrame, path: str, row_numbers: Sequence[str] | None = None
) -> None:
    """Write CSV part files, each with a header.

    ``row_numbers`` names an order; the row's number in it is then written as
    first column ``_c0``.
    """
    if row_numbers is not None:
        df = row_ids(df, row_numbers, "_c0")
    df.write.mode("overwrite").options(**_CSV_FORMAT).csv(path)


# Records in a compressed JSON file, which one task reads.
_PACKED_RECORDS = 100_000


def write_json(df: DataFrame, path: str, packed: bool = False) -> None:
    """Write one JSON record per line, the splittable form :func:`read_json` reads.

    ``packed`` compresses the files, with gzip at its fastest: names and labels that come
    back in every record take about a tenth of the space. Such a file cannot be split, so
    none has more than ``_PACKED_RECORDS`` records.
    """
    writer = df.write.mode("overwrite")
    if packed:
        writer = writer.options(
            **{
                "compression": "gzip",
                "zlib.compress.level": "BEST_SPEED",
                "maxRecordsPerFile": _PACKED_RECORDS,
            }
        )
    writer.json(path)


def write_json_array(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """Write one file that holds one JSON array, with an object per line in ``order``.

    For exchange with tools that know no other form: one task writes the whole file.
    """
    rows = number_rows(df, order, "_number")
    comma = F.when(F.col("_number") > 1, ",").otherwise("")
    text = F.concat(comma, F.to_json(F.struct(*[col(c) for c in df.columns])))
    lines = rows.select("_number", text.alias("value"))
    ends = df.sparkSession.range(2).select(
        F.when(F.col("id") == 0, -1).otherwise((1 << 63) - 1).cast("bigint").alias("_number"),
        F.when(F.col("id") == 0, "[").otherwise("]").alias("value"),
    )
    ordered = lines.union(ends).repartition(1).sortWithinPartitions("_number")
    ordered.select("value").write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str) -> None:
    """Save a table as Parquet."""
    df.write.mode("overwrite").parquet(path)


def publish(df: DataFrame, name: str) -> DataFrame:
    """Make the result available to SQL under ``name`` and return it."""
    df.createOrReplaceTempView(name)
    return df
