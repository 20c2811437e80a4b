"""Filters, projections and imputation. Statistics come from one aggregate and reach the rows as literals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .infer import constant_columns, id_like_columns
from .profile import numeric_columns, string_columns, value_counts


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def fill_values(df: DataFrame, numeric: str = "mean", categorical: str | None = "mode", columns: Sequence[str] | None = None) -> dict:
    """{column: value that stands for NULL}. numeric: mean, median or zero; categorical: mode (lowest value on ties) or a
    constant such as 'Unknown'; None leaves text columns out."""
    chosen = list(columns or df.columns)
    numbers = [c for c in numeric_columns(df) if c in chosen]
    texts = [c for c in string_columns(df) if c in chosen] if categorical else []
    how = {"mean": lambda c: F.avg(_q(c)), "median": lambda c: F.percentile(_q(c).cast("double"), F.lit(0.5)), "zero": lambda c: F.lit(0.0)}[numeric]
    out: dict = {}
    if numbers:
        out |= df.agg(*[how(c).alias(c) for c in numbers]).first().asDict()
    if texts and categorical == "mode":
        best = value_counts(df, texts).groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"))
        modes = {r["column"]: r["value"] for r in best.collect()}
        out |= {c: modes.get(c, "Unknown") for c in texts}
    else:
        out |= {c: categorical for c in texts}
    return out


def impute(df: DataFrame, values: Mapping) -> DataFrame:
    """NULLs (and NaNs of doubles) replaced; numbers are imputed as doubles."""
    types = dict(df.dtypes)

    def filled(c: str) -> Column:
        if types[c] in ("string", "boolean"):
            return F.coalesce(_q(c), F.lit(values[c]).cast(types[c]))
        x = _q(c).cast("double")
        return F.coalesce(F.when(~F.isnan(x), x), F.lit(values[c]).cast("double"), F.lit(0.0))

    return df.withColumns({c: filled(c) for c in values})


def impute_from(df: DataFrame, fit_on: DataFrame, numeric: str = "mean", categorical: str | None = "mode", columns: Sequence[str] | None = None) -> DataFrame:
    """Statistics of one split fill all."""
    return impute(df, fill_values(fit_on, numeric, categorical, columns))


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """What doesn't parse as a number becomes NULL."""
    return df.withColumns({c: _q(c).cast("string").try_cast("double") for c in columns})


def sentinels_to_null(df: DataFrame, sentinels: Mapping[str, str]) -> DataFrame:
    return df.withColumns({c: F.when(F.trim(_q(c).cast("string")) == s, None).otherwise(_q(c)) for c, s in sentinels.items()})


def drop_any_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(subset=list(columns) if columns else None)


def drop_null_numbers(df: DataFrame, columns: Sequence[str], split: str, test: str = "test") -> DataFrame:
    """Rows with a NULL or NaN number go; an error if the test split has any."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | _q(c).isNull() | F.isnan(_q(c).cast("double"))
    if df.where((_q(split) == test) & bad).limit(1).count():
        raise ValueError("the test split has missing numbers")
    return df.where(~bad)


def drop_empty(df: DataFrame) -> DataFrame:
    """All-NULL columns go, then all-NULL rows."""
    row = df.agg(*[F.count(_q(c)).alias(c) for c in df.columns]).first()
    kept = df.select(*[_q(c) for c in df.columns if row[c]])
    return kept.dropna(how="all")


def drop_constant(df: DataFrame) -> DataFrame:
    return df.drop(*[r["column"] for r in constant_columns(df).where("is_constant").collect()])


def drop_id_like(df: DataFrame, **rule) -> DataFrame:
    return df.drop(*[r["column"] for r in id_like_columns(df, **rule).where("id_like").collect()])


def drop_rare_classes(df: DataFrame, target: str, k: int = 5) -> DataFrame:
    """Rows of classes with k rows or fewer go. Classes are counted first and joined back, so no class is one task."""
    rare = df.groupBy(_q(target).alias("_class")).count().where(F.col("count") < k + 1).select("_class")
    return df.join(rare, _q(target).eqNullSafe(F.col("_class")), "left_anti")


def parse_rows(lines: DataFrame, column: str, n: int, delimiter: str = ",") -> DataFrame:
    """fields (array of n texts) of the lines that have n fields; the others are dropped."""
    fields = F.split(F.trim(_q(column)), delimiter)
    return lines.where(F.size(fields) == n).select(F.transform(fields, lambda x: F.trim(x)).alias("fields"))


def reorder(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], target: Sequence[str]) -> tuple[DataFrame, dict, dict]:
    """(df as numeric, categorical, target columns; old index -> new; new index -> old)."""
    order = [*numeric, *categorical, *target]
    forward = {df.columns.index(c): k for k, c in enumerate(order)}
    return df.select(*[_q(c) for c in order]), forward, {v: k for k, v in forward.items()}


def rename_reserved(df: DataFrame, reserved: Sequence[str] = ("value", "variable")) -> tuple[DataFrame, dict]:
    """Reserved names get a marker; the second result renames them back with withColumnsRenamed."""
    new = {c: f"__{c}__" for c in df.columns if c in reserved}
    return df.withColumnsRenamed(new), {v: k for k, v in new.items()}


def argmax_label(df: DataFrame, block: Sequence[str], name: str, levels: Sequence | None = None) -> DataFrame:
    """A one-hot block as one column: the 0-based index of its (first) maximum, or the level there."""
    values = F.array(*[_q(c).cast("double") for c in block])
    index = F.array_position(values, F.array_max(values)) - 1
    label = index if levels is None else F.element_at(F.array(*[F.lit(v) for v in levels]), (index + 1).cast("int"))
    return df.withColumn(name, label).drop(*[c for c in block if c != name])


def concat_columns(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Horizontal concatenation of two tables that share a row key."""
    return left.join(right, key)


def most_frequent_by_group(df: DataFrame, group: str, column: str) -> DataFrame:
    counts = df.groupBy(group, column).count()
    order = Window.partitionBy(group).orderBy(F.desc("count"), column)
    return counts.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r", "count")


def labelled_rows(df: DataFrame, label: str, value: str = "train") -> DataFrame:
    """The rows that carry the label, without its column."""
    return df.where(_q(label) == value).drop(label)


def drop_invalid(df: DataFrame, columns: Sequence[str] | None = None, strict: bool = False) -> DataFrame:
    """Rows of a generated table without NULL or NaN numbers; strict raises if there are any."""
    bad = F.lit(False)
    for c in columns or numeric_columns(df):
        bad = bad | _q(c).isNull() | F.isnan(_q(c).cast("double"))
    if strict and df.where(bad).limit(1).count():
        raise ValueError("the generated table has missing numbers")
    return df.where(~bad)


def cast_parsed(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Texts as the types of a schema: what doesn't parse is 0 in whole types and NULL in floats; fractions are cut off."""
    out = {}
    for c, t in types.items():
        if t in ("tinyint", "smallint", "int", "bigint"):
            out[c] = F.coalesce(_q(c).cast("string").try_cast("double").try_cast(t), F.lit(0).cast(t))
        elif t in ("float", "double"):
            out[c] = _q(c).cast("string").try_cast(t)
        else:
            out[c] = _q(c).cast(t)
    return df.withColumns(out)


def split_blocks(df: DataFrame, key: str, blocks: Mapping[str, Sequence[str]]) -> dict[str, DataFrame]:
    """A table as blocks of columns (numeric, categorical, target, or any), each with the row key."""
    return {name: df.select(_q(key), *[_q(c) for c in columns]) for name, columns in blocks.items()}


def recombine(blocks: Sequence[DataFrame], key: str, order: Sequence[str]) -> DataFrame:
    """Blocks that share a row key as one table, its columns in the source's order."""
    rows = blocks[0]
    for b in blocks[1:]:
        rows = rows.join(b, key)
    return rows.select(*[_q(c) for c in order])
