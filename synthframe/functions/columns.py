"""Column expressions that Spark has no function for; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of Acklam's rational approximation of the normal quantile (relative error below 1.2e-9).
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
_LOW = 0.02425


def _sql_poly(c: tuple, x: str) -> str:
    return reduce(lambda acc, a: f"(({acc}) * {x} + cast({a!r} as double))", c[1:], f"cast({c[0]!r} as double)")


def normal_quantile_sql(p: str) -> str:
    """SQL, the same for Spark and DuckDB, of the standard normal quantile of p in (0, 1)."""
    low, high = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    mid, sq = f"({p} - cast(0.5 as double))", f"(({p} - cast(0.5 as double)) * ({p} - cast(0.5 as double)))"
    return (
        f"case when {p} < cast({_LOW} as double) then ({_sql_poly(_C, low)}) / ({_sql_poly(_D, low)}) "
        f"when {p} > cast({1 - _LOW} as double) then -({_sql_poly(_C, high)}) / ({_sql_poly(_D, high)}) "
        f"else ({_sql_poly(_A, sq)}) * {mid} / ({_sql_poly(_B, sq)}) end"
    )


def normal_quantile(p: str) -> Column:
    return F.expr(normal_quantile_sql(p))


def hash_fraction(*columns: str, seed: int = 0) -> Column:
    """A number in [0, 1) from md5 of the columns' text: the same in every engine and on every run."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def hash_fraction_sql(*columns: str, seed: int = 0) -> str:
    """The same in DuckDB SQL."""
    text = " || '|' || ".join([f"'{seed}'", *[f"coalesce(cast({c} as varchar), '')" for c in columns]])
    return f"(cast(('0x' || substr(md5({text}), 1, 8)) as bigint) / cast(4294967296 as double))"


def hash_pick(*columns: str, seed: int = 0) -> Column:
    """A whole number in [0, 2^60) from md5 of the columns' text, the same in every engine; pmod makes it a row number."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def hash_pick_sql(*columns: str, seed: int = 0) -> str:
    """The same in DuckDB SQL."""
    text = " || '|' || ".join([f"'{seed}'", *[f"coalesce(cast({c} as varchar), '')" for c in columns]])
    return f"cast(('0x' || substr(md5({text}), 1, 15)) as bigint)"


def safe_divide(a: Column, b: Column, default: float | None = None) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(default).cast("double"))
