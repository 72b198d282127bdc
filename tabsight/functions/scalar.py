"""Column expressions.  All are built-in Spark expressions, so they
stay inside whole-stage codegen."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_nan(c) -> Column:
    """NaN and null are two markers in Spark; the reference has one."""
    c = col_(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def product(a, b) -> Column:
    """G1: interaction term."""
    return col_(a) * col_(b)


def square(a) -> Column:
    """G2."""
    return col_(a) * col_(a)


def sqrt_abs(a) -> Column:
    """The scale-location transform."""
    return F.sqrt(F.abs(col_(a)))


def linear_eval(x, slope: Column | float, intercept: Column | float) -> Column:
    """Evaluate a degree-1 fit."""
    return F.lit(slope) * col_(x) + F.lit(intercept) if not isinstance(slope, Column) else slope * col_(x) + intercept


def clip01(a) -> Column:
    """G5."""
    return F.least(F.greatest(col_(a), F.lit(0.0)), F.lit(1.0))


def round_half_even(a, digits: int) -> Column:
    """Python's round() is half-even; Spark's ``round`` is half-up."""
    return F.bround(col_(a), digits)


def as_label(a) -> Column:
    """Pandas ``astype(str)``: a missing value becomes the text 'nan'."""
    return F.coalesce(col_(a).cast("string"), F.lit("nan"))


def fill(a, value) -> Column:
    """G8."""
    return F.coalesce(col_(a), F.lit(value))


def standardise(a, mean: Column, std_pop: Column) -> Column:
    """(x - mean) / population std, 0 for a constant column."""
    return F.coalesce((col_(a) - mean) / F.nullif(std_pop, F.lit(0.0)), F.lit(0.0))


def binarise(label, cls) -> Column:
    """One-vs-rest indicator."""
    return (col_(label) == F.lit(cls)).cast("int")


def safe_div(a, b) -> Column:
    return col_(a) / F.nullif(col_(b), F.lit(0))
