"""Embedded JSON, nested tables and nested objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plurality.functions import col
from plurality.operators.indexing import unused
from plurality.session import materialise


def parse_json(
    df: DataFrame, source: str, schema: T.DataType, target: str = "json_parsed"
) -> DataFrame:
    """Add ``target``, the JSON text of ``source`` parsed to ``schema``.

    Text that is not one JSON value, or does not fit the schema, fails the
    job; see :func:`split_json_rejects` for the forgiving form. NULL stays NULL.
    ``inline`` makes the result a column that later filters use as it is; on a plain
    expression Spark would repeat the parsing in every filter.
    """
    held = unused(df, "_held")
    read = df.select("*", F.inline(F.array(F.struct(_held(source, schema).alias(held)))))
    return read.select(*[col(c) for c in df.columns], _body(source, held).alias(target))


# The name of the field behind a text that cannot spell it.
_END = "_end"


def _end_name(source: Column) -> Column:
    """A field name that does not stand in the text: it may spell none but by escapes."""
    free = ~F.contains(source, F.lit(_END)) & ~F.contains(source, F.lit("\\"))
    return F.when(free, _END).otherwise(F.md5(source))


def _held(source: str, schema: T.DataType) -> Column:
    """The text parsed in one pass, as value of a map with one more key behind it.

    The parser stops after the first complete value, so the text is put into an object
    with a field behind it. The text cannot spell that field's name, nor its own digest,
    so the object did not end inside the text if the field is found; and any field that
    the text adds is one more key. Else the text is not one JSON value.
    """
    name = _end_name(col(source))
    text = F.concat(F.lit('{"_body":'), col(source), F.lit(',"'), name, F.lit('":null}'))
    return F.from_json(text, T.MapType(T.StringType(), schema), {"mode": "FAILFAST"})


def _body(source: str, held: str) -> Column:
    """The parsed value in the map of :func:`_held`; an error if the text was not whole."""
    broken = F.raise_error(F.lit(f"malformed JSON in column {source}"))
    whole = F.map_keys(col(held)) == F.array(F.lit("_body"), _end_name(col(source)))
    return F.when(whole | col(source).isNull(), F.map_values(col(held))[0]).otherwise(broken)


def split_json_rejects(
    df: DataFrame, source: str, schema: T.DataType, target: str = "json_parsed"
) -> tuple[DataFrame, DataFrame]:
    """The rows :func:`parse_json` accepts, parsed, and the other rows as given.

    Every text is parsed once, here and now, and both results are written apart; reading
    one of them, however often, reads nothing of the other.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    read = _read_json(df, source, schema, options)
    whole = col("_whole") & col("_corrupt").isNull()
    fine = F.coalesce(whole, F.lit(False)) | col(source).isNull()
    verdict = unused(df, "_fine")
    given = [col(c) for c in df.columns]
    body = F.when(fine, col("_body")).alias(target)
    both = materialise(read.select(*given, body, fine.alias(verdict)), "parsed", verdict)
    good = both.filter(col(verdict)).select(*given, col(target))
    return good, both.filter(~col(verdict)).select(*given)


def _read_json(
    df: DataFrame, source: str, schema: T.DataType, options: dict[str, str]
) -> DataFrame:
    """Add ``_body``, the parsed text, and ``_whole``, true if it is one value.

    For parsing that keeps what fails; see :func:`_held` for one pass that does not.

    The parser stops after the first complete value, so the text is put into
    an object with a field behind it. That field holds the text's digest: the
    object did not end inside the text, which would have to hold its own digest.
    And the object has no other fields, so the text added none. ``inline`` makes
    the results columns that later filters use as they are; on a plain
    expression Spark would repeat the parsing in every filter.
    """
    wrapper = T.StructType(
        [
            T.StructField("_body", schema),
            T.StructField("_end", T.StringType()),
            T.StructField("_corrupt", T.StringType()),
        ]
    )
    digest = F.md5(col(source))
    opened = F.concat(F.lit('{"_body":'), col(source))
    text = F.concat(opened, F.lit(',"_end":"'), digest, F.lit('"}'))
    parsed = df.select("*", F.inline(F.array(F.from_json(text, wrapper, options))))
    fields = F.json_object_keys(F.concat(opened, F.lit(',"_end":0}')))
    only = fields == F.array(F.lit("_body"), F.lit("_end"))
    whole = F.struct((only & (col("_end") == digest)).alias("_whole"))
    return parsed.select("*", F.inline(F.array(whole)))


def unnest(df: DataFrame, column: str) -> DataFrame:
    """One row per element of an array-of-structs column, other columns repeated.

    Rows whose array is empty or NULL disappear.
    """
    inner = df.schema[column].dataType
    if not (
        isinstance(inner, T.ArrayType) and isinstance(inner.elementType, T.StructType)
    ):
        raise ValueError(f"{column} is not an array of structs")
    outer = [c for c in df.columns if c != column]
    clash = set(outer) & set(inner.elementType.names)
    if clash:
        raise ValueError(f"unnesting {column} would repeat columns {sorted(clash)}")
    # For a bare column Spark adds a filter on its size, which for a parsed
    # column means parsing every text again. An expression avoids that.
    elements = F.coalesce(col(column), F.array().cast(inner))
    return df.select(*[col(c) for c in outer], F.inline(elements))


def flatten_structs(df: DataFrame, sep: str = ".") -> DataFrame:
    """Replace struct columns, at any depth, by ``outer<sep>inner`` columns."""
    return df.select(
        *[
            leaf
            for field in df.schema.fields
            for leaf in _leaves(col(field.name), field.name, field.dataType, sep)
        ]
    )


def _leaves(column: Column, name: str, kind: T.DataType, sep: str) -> list[Column]:
    if not isinstance(kind, T.StructType):
        return [column.alias(name)]
    return [
        leaf
        for field in kind.fields
        for leaf in _leaves(
            column.getField(field.name), f"{name}{sep}{field.name}", field.dataType, sep
        )
    ]


def flatten_forms(
    forms: DataFrame, payload: str, schema: T.DataType, fields: str = "fields"
) -> DataFrame:
    """Observer forms to one row per field: parse, unnest twice, drop the text."""
    others = [col(c) for c in forms.columns if c != payload]
    # No filter on the sections themselves can follow, so plain columns do.
    held = unused(forms, "_held")
    read = forms.withColumn(held, _held(payload, schema))
    parsed = read.select(*others, _body(payload, held).alias("json_parsed"))
    return flatten_structs(unnest(unnest(parsed, "json_parsed"), fields))
