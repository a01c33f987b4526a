"""Result cells as text: normal form, precision and tolerant equality as column expressions.

A cell's normal form is a struct: ``num`` for numbers and truth words, ``txt`` for other text
(and for whole numbers too long for a double). NULL cells have both fields NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RELATIVE_TOLERANCE = 1e-4
CLOSE_TOLERANCE = 0.05

_DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def is_number(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike(_DECIMAL), F.lit(False))


def _word(text: Column) -> Column:
    return F.lower(F.trim(text))


def _read(word: Column) -> Column:
    """Lower-case word and its number, if it is one."""
    num = (
        F.when(word.isin("true", "yes"), 1.0)
        .when(word.isin("false", "no"), 0.0)
        .when(word.rlike(_DECIMAL), word.try_cast("double"))
    )
    return F.named_struct(F.lit("word"), word, F.lit("num"), num)


def _normal(read: Column) -> Column:
    word = read["word"]
    long_integer = (F.length(word) > 15) & word.rlike(r"^[+-]?0*[1-9][0-9]{15,}$")
    txt = F.when(read["num"].isNull(), word).when(long_integer, F.regexp_replace(word, r"^\+?(-?)0*", "$1"))
    return F.named_struct(F.lit("num"), read["num"], F.lit("txt"), txt)


def normalize_value(text: Column) -> Column:
    """Trim, read truth words as 1 and 0, read numbers, lower everything else."""
    return _normal(_read(_word(text)))


def read_row(cells: Column) -> Column:
    """The word and number of each cell, from which its normal form and decimals follow; lambdas compute their argument once."""
    return F.transform(F.transform(cells, lambda c: _word(c)), lambda w: _read(w))


def normal_forms(read: Column) -> Column:
    return F.transform(read, lambda r: _normal(r))


def places_of(read: Column) -> Column:
    """The decimal places of each cell of ``read_row``; a truth word has a number and no places."""
    return F.transform(read, lambda r: F.when(r["num"].isNotNull() & ~r["word"].isin("true", "yes", "false", "no"), _places(r["word"])))


def normalize_row(cells: Column) -> Column:
    return normal_forms(read_row(cells))


def _places(number: Column) -> Column:
    fraction = F.rtrim(F.split_part(number, F.lit("."), F.lit(2)), F.lit("0"))
    return F.when(number.contains("."), F.length(fraction)).otherwise(F.lit(0))


def decimal_places(text: Column) -> Column:
    """Digits after the point without trailing zeros; 0 without a point, NULL when not a number."""
    return F.when(is_number(text), _places(F.trim(text)))


def values_equal(a: Column, b: Column, tolerance: float = RELATIVE_TOLERANCE) -> Column:
    """Tolerant equality of two normal forms; NULL equals NULL only."""
    x, y = a["num"], b["num"]
    gap = F.abs(x - y)
    scale = F.greatest(F.abs(x), F.abs(y))
    close = (
        F.when((x == 0) & (y == 0), True)
        .when((x == 0) | (y == 0), gap < tolerance)
        .otherwise(F.coalesce(F.try_divide(gap, scale) < tolerance, F.lit(False)) | (x == y))
    )
    same_text = x.isNull() & y.isNull() & a["txt"].eqNullSafe(b["txt"])
    return F.when(x.isNotNull() & y.isNotNull(), close).otherwise(same_text)


def values_equal_adaptive(a: Column, b: Column, places: Column) -> Column:
    """Equal after rounding both to ``places`` decimals, or tolerantly equal."""
    shift = F.pow(F.lit(10.0), places)
    rounded = F.bround(a["num"] * shift, 0) == F.bround(b["num"] * shift, 0)
    return F.coalesce(rounded, F.lit(False)) | values_equal(a, b)


def rows_equal(a: Column, b: Column) -> Column:
    same = F.forall(F.zip_with(a, b, lambda x, y: values_equal(x, y)), lambda ok: ok)
    return (F.size(a) == F.size(b)) & same


def rows_equal_adaptive(a: Column, b: Column, places: Column) -> Column:
    """Cell-wise adaptive equality; ``places`` are the decimals of the governing side."""
    joined = F.arrays_zip(a.alias("a"), b.alias("b"), places.alias("p"))
    same = F.forall(joined, lambda c: values_equal_adaptive(c["a"], c["b"], c["p"]))
    return (F.size(a) == F.size(b)) & same


def values_subset(few: Column, many: Column) -> Column:
    """Every value of ``few`` equals some value of ``many``."""
    return F.forall(few, lambda v: F.exists(many, lambda w: values_equal(v, w)))


def python_float_text(value: Column) -> Column:
    """A double as the usual decimal text: ``10000000.0`` where Spark would write ``1.0E7``."""
    text = value.cast("string")
    plain = F.abs(value).between(1e-4, 1e16) & text.contains("E")
    wide = text.try_cast("decimal(38,18)").cast("string")
    short = F.regexp_replace(F.regexp_replace(wide, "0+$", ""), r"\.$", ".0")
    return F.when(plain, short).otherwise(text)
