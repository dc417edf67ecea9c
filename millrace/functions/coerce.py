"""Coercions between the JSON value kinds, as NULL-safe Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the texts a big decimal can be parsed from.
NUMBER_TEXT = r"\A[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"

VARIANT = T.VariantType()
NESTED = (T.StructType, T.MapType)


def is_variant(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.VariantType)


def same_type(a: T.DataType, b: T.DataType) -> bool:
    """Equal but for nullability."""
    return a.simpleString() == b.simpleString()


def to_variant(col: Column, dtype: T.DataType) -> Column:
    if is_variant(dtype):
        return col
    if isinstance(dtype, NESTED) or (isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, NESTED)):
        return F.to_variant_object(col)
    return col.cast(VARIANT)


def plain_decimals(col: Column, dtype: T.DataType) -> tuple[Column, T.DataType]:
    """Decimals print all digits of their scale; as variants they print what they need."""
    if "decimal" in dtype.simpleString() and not isinstance(dtype, NESTED):
        return to_variant(col, dtype), VARIANT
    return col, dtype


def to_json_text(col: Column, dtype: T.DataType) -> Column:
    """JSON text of one value; NULL stays NULL."""
    col, dtype = plain_decimals(col, dtype)
    if isinstance(dtype, (T.ArrayType, *NESTED)):
        return F.to_json(col)
    return F.to_json(to_variant(col, dtype))


def _plain_decimal(col: Column, scale: int) -> Column:
    # A decimal column prints all its scale digits; a JSON number does not.
    text = col.cast("string")
    return (
        F.when(text.endswith("." + "0" * scale), F.substring(text, F.lit(1), F.length(text) - (scale + 1)))
        .when(text.contains("E"), F.when(col == 0, F.lit("0")).otherwise(text))  # not in ANSI mode
        .otherwise(F.rtrim(text, F.lit("0")))
    )


def _array_body(json: Column) -> Column:
    return F.substring(json, F.lit(2), F.length(json) - 2)


def to_text(col: Column, dtype: T.DataType) -> Column:
    """Text of a value: scalars as they are, arrays as their elements' JSON joined
    by commas, objects as JSON. NULL stays NULL, so lookups can tell absence."""
    if isinstance(dtype, T.StringType):
        return col
    if isinstance(dtype, T.DecimalType):
        return _plain_decimal(col, dtype.scale) if dtype.scale else col.cast("string")
    if isinstance(dtype, T.ArrayType):
        return _array_body(to_json_text(col, dtype))
    if isinstance(dtype, NESTED):
        return F.to_json(col)
    if is_variant(dtype):
        text = F.try_variant_get(col, "$", "string")
        return F.when(F.schema_of_variant(col).startswith("ARRAY"), _array_body(text)).otherwise(text)
    return col.cast("string")


def json_to_text(json: Column) -> Column:
    """:func:`to_text` of a value that is given as JSON text."""
    return (
        F.when(json.startswith('"'), F.get_json_object(json, "$"))
        .when(json.startswith("["), _array_body(json))
        .when(json == "null", F.lit(""))
        .otherwise(json)
    )


def _fitting(value: Column, number: T.DecimalType, on_error: str) -> Column:
    """The value as ``number``; beyond it the query fails, or the result is NULL."""
    fit = value.try_cast(number)
    if on_error != "fail":
        return fit
    bad = F.raise_error(F.concat(F.lit(f"Not within {number.simpleString()}: "), F.coalesce(value.cast("string"), F.lit("")))).cast(number)
    return F.coalesce(fit, bad)


def text_to_number(text: Column, number: T.DecimalType, on_error: str = "null") -> Column:
    """Empty or unparsable text is 0; a number beyond ``number`` fails the query or is NULL,
    never 0."""
    return F.when(text.rlike(NUMBER_TEXT), _fitting(text, number, on_error)).otherwise(F.lit(0).cast(number))


def number_fault(text: Column, number: T.DecimalType) -> Column:
    """True where :func:`text_to_number` had to give NULL."""
    return F.coalesce(text.rlike(NUMBER_TEXT) & text.try_cast(number).isNull(), F.lit(False))


def text_to_boolean(text: Column, on_error: str = "fail") -> Column:
    """``true``/``false`` in any case; all else fails the query or becomes NULL."""
    lowered = F.lower(text)
    if on_error == "fail":
        bad = F.raise_error(F.concat(F.lit("Not a boolean: "), F.coalesce(text, F.lit("")))).cast("boolean")
    else:
        bad = F.lit(None).cast("boolean")
    return F.when(lowered == "true", F.lit(True)).when(lowered == "false", F.lit(False)).otherwise(bad)


def boolean_fault(text: Column) -> Column:
    """True where :func:`text_to_boolean` has no answer."""
    return ~F.coalesce(F.lower(text).isin("true", "false"), F.lit(False))


def to_number(col: Column, dtype: T.DataType, number: T.DecimalType = T.DecimalType(38, 18), on_error: str = "null") -> Column:
    """Number of any value: booleans are 1/0, arrays, objects and NULL are 0."""
    zero = F.lit(0).cast(number)
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(col.cast("int").cast(number), zero)
    if isinstance(dtype, T.NumericType):
        return F.when(col.isNotNull(), _fitting(col, number, on_error)).otherwise(zero)
    if isinstance(dtype, (T.ArrayType, *NESTED)):
        return zero
    if is_variant(dtype):
        kind = F.schema_of_variant(col)
        flag = F.try_variant_get(col, "$", "boolean").cast("int").cast(number)
        nested = kind.startswith("ARRAY") | kind.startswith("OBJECT")
        return (
            F.when(col.isNull() | nested, zero)
            .when(kind == "BOOLEAN", F.coalesce(flag, zero))
            .otherwise(text_to_number(F.try_variant_get(col, "$", "string"), number, on_error))
        )
    return text_to_number(to_text(col, dtype), number, on_error)


def to_boolean(col: Column, dtype: T.DataType, on_error: str = "fail") -> Column:
    """Truth of any value: numbers that truncate to 1, arrays and objects that hold
    something; NULL is false."""
    no = F.lit(False)
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(col, no)
    if isinstance(dtype, T.NumericType):
        return F.coalesce((col >= 1) & (col < 2), no)
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        return F.coalesce(F.size(col) > 0, no)
    if isinstance(dtype, T.StructType):
        return F.coalesce(F.to_json(col) != "{}", no)
    if is_variant(dtype):
        kind = F.schema_of_variant(col)
        text = F.try_variant_get(col, "$", "string")
        number = F.try_variant_get(col, "$", "double")
        return (
            F.when(col.isNull() | (kind == "VOID"), no)
            .when(kind.startswith("ARRAY"), text != "[]")
            .when(kind.startswith("OBJECT"), text != "{}")
            .when(kind.isin("STRING", "BOOLEAN"), text_to_boolean(text, on_error))
            .otherwise(F.coalesce((number >= 1) & (number < 2), no))
        )
    return F.when(col.isNull(), no).otherwise(text_to_boolean(to_text(col, dtype), on_error))
