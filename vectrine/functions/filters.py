"""The metadata filter language, compiled to one boolean column.

A specification maps fields to operators: ``{"chapter": {"<=": 5}, "genre": {"==": "fiction"}}``.  All of them have to hold.  A field
that is missing or null fails every operator, negative ones included; ``{"field": {}}`` asks for presence only.  Fields are
columns of the frame, or else keys of a ``metadata`` column (VARIANT, MAP or STRUCT).  Values keep their own types: numbers and
booleans compare as numbers, texts as texts, and orderings between them go by number where both read as one, else by their printed forms.
Whole numbers compare exactly, however large.  On columns of one type a filter is a plain comparison, which a scan can take over.
"""

from __future__ import annotations

import math
import operator
import warnings
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Value:
    """A field seen through its possible types; absent readings are null.  text is the form in which Python prints it.

    whole: its exact reading as a whole number, if it has one; number: any number as a double.  kind: the type of a column that has one.
    """

    present: Column
    is_text: Column
    is_number: Column
    is_list: Column
    number: Column
    text: Column
    items: Column
    whole: Column | None = None
    column: Column | None = None
    kind: T.DataType | None = None


def _quoted(item: Column) -> Column:
    return F.concat(F.lit("'"), item, F.lit("'"))


def _printed_list(items: Column, quote: bool) -> Column:
    parts = F.transform(items, (lambda x: _quoted(x.cast("string"))) if quote else (lambda x: x.cast("string")))
    return F.concat(F.lit("["), F.array_join(parts, ", "), F.lit("]"))


def _typed(column: Column, kind: T.DataType) -> Value:
    no, yes = F.lit(False), F.lit(True)
    nothing, empty = F.lit(None).cast("double"), F.lit(None).cast("array<string>")
    present = column.isNotNull()
    if isinstance(kind, T.BooleanType):
        return Value(
            present,
            no,
            yes,
            no,
            column.cast("int").cast("double"),
            F.when(column, "True").otherwise("False"),
            empty,
            column.cast("long"),
            column,
            kind
        )
    if isinstance(kind, T.NumericType):
        whole = column.cast("long") if isinstance(kind, T.IntegralType) else None
        return Value(present, no, yes, no, column.cast("double"), column.cast("string"), empty, whole, column, kind)
    if isinstance(kind, T.ArrayType):
        return Value(
            present, no, no, yes, nothing, _printed_list(column, isinstance(kind.elementType, T.StringType)), column.cast("array<string>")
        )
    return Value(present, yes, no, no, column.cast("string").try_cast("double"), column.cast("string"), empty, None, column, kind)


def _variant(column: Column) -> Value:
    tag = F.schema_of_variant(column)
    is_text, is_list = tag == "STRING", F.startswith(tag, F.lit("ARRAY"))
    is_bool = tag == "BOOLEAN"
    is_number = is_bool | tag.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(tag, F.lit("DECIMAL"))
    number = F.when(is_bool, F.try_variant_get(column, "$", "boolean").cast("int").cast("double")).otherwise(
        F.try_variant_get(column, "$", "double")
    )
    items = F.try_variant_get(column, "$", "array<string>")
    printed = F.when(is_bool, F.initcap(F.try_variant_get(column, "$", "string"))).when(is_list, _printed_list(items, True)).otherwise(
        F.try_variant_get(column, "$", "string")
    )
    whole = F.when(tag == "BIGINT", F.try_variant_get(column, "$", "long"))
    return Value(column.isNotNull() & (tag != "VOID"), is_text, is_number, is_list, number, printed, items, whole)


def resolve(df: DataFrame, field: str) -> Value | None:
    """A column of the frame, else a key of its ``metadata``; None if there is neither."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if field in kinds:
        kind = kinds[field]
        return _variant(F.col(f"`{field}`")) if isinstance(kind, T.VariantType) else _typed(F.col(f"`{field}`"), kind)
    held = kinds.get("metadata")
    if isinstance(held, T.VariantType):
        name = field.replace("'", "\\'")
        return _variant(F.try_variant_get(F.col("metadata"), f"$['{name}']", "variant"))
    if isinstance(held, T.MapType):
        return _typed(F.try_element_at(F.col("metadata"), F.lit(field)), held.valueType)
    if isinstance(held, T.StructType) and field in held.names:
        return _typed(F.col("metadata").getField(field), held[field].dataType)
    return None


def _number(value: Any) -> int | float | None:
    """A number as Python reads it; whole ones stay exact."""
    if isinstance(value, (bool, int, float)):
        return int(value) if isinstance(value, bool) else value
    for kind in (int, float):
        try:
            return kind(value)
        except (TypeError, ValueError):
            pass
    return None


_FLIPPED = {"<": "<=", ">=": ">", "<=": "<=", ">": ">"}
_COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
_LONG = 1 << 63


def _whole_column(column: Column, name: str, wanted: int | float) -> Column:
    """A comparison of a column of whole numbers, exact for any number."""
    if isinstance(wanted, float) and math.isnan(wanted):
        return F.lit(name == "!=")
    if isinstance(wanted, float) and math.isfinite(wanted) and not wanted.is_integer():
        if name in ("==", "!="):
            return F.lit(name == "!=")
        # x < 3.5 is x <= 3, x >= 3.5 is x > 3
        name, wanted = _FLIPPED[name], math.floor(wanted)
    if not -_LONG <= wanted < _LONG:
        return F.lit(name == "!=" or (name in ("<", "<=")) == (wanted > 0) and name != "==")
    return _COMPARE[name](column, F.lit(int(wanted)))


def _double_column(column: Column, name: str, wanted: int | float) -> Column:
    """A comparison of a column of floating point, exact for any number; what isn't a number meets ``!=`` only."""
    if isinstance(wanted, float) and math.isnan(wanted):
        return F.lit(name == "!=")
    try:
        near = float(wanted)
    except OverflowError:
        near = math.inf if wanted > 0 else -math.inf
    if near != wanted:
        if name in ("==", "!="):
            return F.lit(name == "!=")
        # no double lies between the number and the one nearest to it
        name = {"<": "<", "<=": "<", ">": ">=", ">=": ">="}[name] if near > wanted else {"<": "<=", "<=": "<=", ">": ">", ">=": ">"}[name]
    out = _COMPARE[name](column, F.lit(near))
    return out & ~F.isnan(column) if name in (">", ">=") else out


def compare(v: Value, name: str, wanted: int | float) -> Column:
    """A field that is a number against a number."""
    if v.kind is not None and v.whole is not None:
        return _whole_column(v.whole if isinstance(v.kind, T.BooleanType) else v.column, name, wanted)
    if isinstance(v.kind, T.DecimalType) and isinstance(wanted, int) and abs(wanted) < 10**38:
        return _COMPARE[name](v.column, F.lit(str(wanted)).cast("decimal(38,0)"))
    if isinstance(v.kind, (T.FloatType, T.DoubleType)):
        return _double_column(v.column if isinstance(v.kind, T.DoubleType) else v.number, name, wanted)
    by_double = _double_column(v.number, name, wanted)
    return by_double if v.whole is None else F.when(v.whole.isNotNull(), _whole_column(v.whole, name, wanted)).otherwise(by_double)


def equal(v: Value, wanted: Any) -> Column:
    if isinstance(wanted, str):
        return v.text == wanted if isinstance(v.kind, T.StringType) else v.is_text & (v.text == wanted)
    if isinstance(wanted, (bool, int, float)):
        if v.kind is None:
            return v.is_number & compare(v, "==", _number(wanted))
        return compare(v, "==", _number(wanted)) if isinstance(v.kind, (T.NumericType, T.BooleanType)) else F.lit(False)
    if isinstance(wanted, (list, tuple)):
        return v.is_list & (v.text == str(list(wanted)))
    return F.lit(False)


def _ordering(name: str) -> Callable[[Value, Any], Column]:
    def run(v: Value, wanted: Any) -> Column:
        by_text = _COMPARE[name](v.text, F.lit(str(wanted)))
        n = _number(wanted)
        if isinstance(v.kind, (T.NumericType, T.BooleanType)):
            return by_text if n is None else compare(v, name, n)
        if n is None or (isinstance(v.kind, T.StringType) and isinstance(wanted, str)):
            return by_text
        reading = F.when(v.is_text, v.text.try_cast("double")).otherwise(v.number)
        by_number = F.when(v.is_number, compare(v, name, n)).when(reading.isNotNull(), _double_column(reading, name, n)).otherwise(by_text)
        return F.when(v.is_text, by_text).otherwise(by_number) if isinstance(wanted, str) else by_number

    return run


def _unequal(v: Value, wanted: Any) -> Column:
    if isinstance(v.kind, T.StringType) and isinstance(wanted, str):
        return v.text != wanted
    if isinstance(v.kind, (T.NumericType, T.BooleanType)) and isinstance(wanted, (bool, int, float)):
        return compare(v, "!=", _number(wanted))
    return ~F.coalesce(equal(v, wanted), F.lit(False))


def _within(v: Value, wanted: Any) -> Column:
    if isinstance(v.kind, T.StringType):
        return v.text.isin([x for x in wanted if isinstance(x, str)])
    if isinstance(v.kind, T.IntegralType):
        numbers = [_number(x) for x in wanted if isinstance(x, (bool, int, float))]
        return v.column.isin([int(x) for x in numbers if math.isfinite(x) and x == int(x) and -_LONG <= x < _LONG])
    return reduce(lambda a, b: a | b, (F.coalesce(equal(v, x), F.lit(False)) for x in wanted), F.lit(False))


def _in(v: Value, wanted: Any) -> Column:
    return _within(v, wanted) if isinstance(wanted, (list, tuple, set)) else F.lit(False)


def _not_in(v: Value, wanted: Any) -> Column:
    return ~_within(v, wanted) if isinstance(wanted, (list, tuple, set)) else F.lit(False)


def truth(v: Value) -> Column:
    """As Python sees the field: a number other than 0, a list or text that isn't empty."""
    if isinstance(v.kind, T.BooleanType):
        return v.column
    if isinstance(v.kind, T.NumericType):
        return v.column != 0
    if isinstance(v.kind, T.StringType):
        return v.text != ""
    return F.when(v.is_number, v.number != 0).when(v.is_list, F.size(v.items) > 0).otherwise(F.length(v.text) > 0)


#: name -> builder of a column from a field and the wanted value; may be extended
OPERATORS: dict[str, Callable[[Value, Any], Column]] = {
    "==": equal,
    "!=": _unequal,
    "<": _ordering("<"),
    "<=": _ordering("<="),
    ">": _ordering(">"),
    ">=": _ordering(">="),
    "in": _in,
    "not_in": _not_in,
    "contains": lambda v, w: F.contains(v.text, F.lit(str(w))),
    "starts_with": lambda v, w: F.startswith(v.text, F.lit(str(w))),
    "ends_with": lambda v, w: F.endswith(v.text, F.lit(str(w))),
    "is_true": lambda v, w: truth(v),
    "is_false": lambda v, w: ~truth(v),
    # an extension: any item of a list field is among the wanted ones
    "any_of": lambda v, w: F.when(v.is_list, F.arrays_overlap(v.items, F.array(*(F.lit(str(x)) for x in w)))).otherwise(_in(v, w)),
}


def conditions(df: DataFrame, filters: dict[str, dict[str, Any]] | None, strict: bool = False) -> list[Column]:
    """Predicates that all have to hold; where one is null, the row is refused.

    An unknown operator refuses every row with a warning, or raises if ``strict``.
    """
    parts: list[Column] = []
    for field, wanted in (filters or {}).items():
        value = resolve(df, field)
        if value is None:
            return [F.lit(False)]
        parts.append(value.present)
        for name, literal in wanted.items():
            builder = OPERATORS.get(name)
            if builder is None:
                if strict:
                    raise ValueError(f"unknown filter operator {name!r}")
                warnings.warn(f"unknown filter operator {name!r} refuses all rows", stacklevel=3)
                return [F.lit(False)]
            parts.append(builder(value, literal))
    return parts


def compile_filters(df: DataFrame, filters: dict[str, dict[str, Any]] | None, strict: bool = False) -> Column:
    """One flag for all of ``filters``, true or false; rows on which it can't be evaluated are refused."""
    return F.coalesce(reduce(and_, conditions(df, filters, strict), F.lit(True)), F.lit(False))


def apply_filters(df: DataFrame, filters: dict[str, dict[str, Any]] | None, strict: bool = False) -> DataFrame:
    """``df`` itself without filters, else its rows that meet all of them; comparisons reach the scan."""
    return df.where(reduce(and_, conditions(df, filters, strict))) if filters else df
