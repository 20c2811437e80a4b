"""Preparing a split table for a model: fixed steps in a fixed order, all fitted on the training split."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import fill_values, impute
from .encode import collapse_rare, label_codes, quantile_transform, scale_minmax, zscore


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


@dataclass(frozen=True)
class Transformations:
    """What to do, or None to leave it. normalization: standard, minmax or quantile; missing_numbers: mean or drop;
    missing_categories: mode or a constant; rare_share: categories below this share of the training rows are one;
    encoding: code (sorted level, unseen one past the last); target: standard (regression only)."""

    normalization: str | None = None
    missing_numbers: str | None = None
    missing_categories: str | None = None
    rare_share: float | None = None
    encoding: str | None = None
    target: str | None = "standard"

    def key(self) -> str:
        """Names the result of these steps: equal steps, equal key."""
        return hashlib.md5(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


def standardize_target(df: DataFrame, target: str, train: DataFrame) -> tuple[DataFrame, dict]:
    """(df with the target as (y - mean) / population deviation of the training rows, {mean, std}); a constant has std 1."""
    mean, std = train.agg(F.avg(_q(target)), F.stddev_pop(_q(target))).first()
    info = {"mean": mean or 0.0, "std": std or 1.0}
    return df.withColumn(target, (_q(target).cast("double") - F.lit(info["mean"])) / F.lit(info["std"])), info


def restore_target(df: DataFrame, column: str, info: dict) -> DataFrame:
    return df.withColumn(column, _q(column) * F.lit(info["std"]) + F.lit(info["mean"]))


def arrange_target(numeric: Sequence[str], categorical: Sequence[str], target: str, task: str) -> tuple[list[str], list[str]]:
    """(numeric, categorical) columns with the target as the first numeric one of a regression, else the first categorical."""
    return ([target, *numeric], list(categorical)) if task == "regression" else (list(numeric), [target, *categorical])


def transform_table(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], target: str, task: str, steps: Transformations, split: str = "split", train: str = "train"
) -> tuple[DataFrame, dict]:
    """(df with its columns transformed in place, what restores the target).

    In this order: missing numbers, normalisation, missing categories, rare categories, codes, target; each is fitted on the
    training rows as the steps before left them. Rows go only with missing_numbers='drop', in every split."""
    rows, numeric, categorical = df, list(numeric), list(categorical)

    def fitted() -> DataFrame:
        return rows.where(_q(split) == train)

    if numeric and steps.missing_numbers == "drop":
        for c in numeric:
            rows = rows.where(_q(c).isNotNull() & ~F.isnan(_q(c).cast("double")))
    elif numeric and steps.missing_numbers:
        rows = impute(rows, fill_values(fitted(), steps.missing_numbers, None, numeric))
    if numeric and steps.normalization == "standard":
        rows = zscore(rows, numeric, fit_on=fitted())
        rows = rows.withColumns({c: _q(f"{c}_z") for c in numeric}).drop(*[f"{c}_z" for c in numeric])
    elif numeric and steps.normalization == "minmax":
        ends = fitted().agg(*[F.struct(F.min(_q(c)).cast("double"), F.max(_q(c)).cast("double")).alias(c) for c in numeric]).first()
        rows = rows.withColumns({c: scale_minmax(c, *ends[c]) for c in numeric})
    elif steps.normalization == "quantile":
        for c in numeric:
            rows = quantile_transform(rows, c, normal=True, fit_on=fitted()).withColumn(c, _q(f"{c}_g")).drop(f"{c}_u", f"{c}_g")
    if categorical and steps.missing_categories:
        rows = rows.withColumns({c: _q(c).cast("string") for c in categorical})
        rows = impute(rows, fill_values(fitted(), categorical=steps.missing_categories, columns=categorical))
    if steps.rare_share:
        for c in categorical:
            rows = collapse_rare(rows, c, steps.rare_share, fit_on=fitted())
    if steps.encoding == "code":
        for c in categorical:
            rows = label_codes(rows, c, "_coded", fit_on=fitted(), unseen="next").withColumn(c, F.col("_coded")).drop("_coded")
    info = {}
    if steps.target == "standard" and task == "regression":
        rows, info = standardize_target(rows, target, fitted())
    return rows.select(*[_q(c) for c in df.columns]), info


def cached_transform(df: DataFrame, folder: str, *args, steps: Transformations, **kwargs) -> tuple[DataFrame, dict]:
    """transform_table whose result stays in folder under the key of its steps; a second call with equal steps reads it.
    One folder is for one table."""
    spark = df.sparkSession
    path = f"{folder.rstrip('/')}/cache-{steps.key()}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}-info/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        rows, info = transform_table(df, *args, steps=steps, **kwargs)
        rows.write.mode("overwrite").parquet(path)
        spark.createDataFrame([(json.dumps(info),)], "info string").coalesce(1).write.mode("overwrite").parquet(f"{path}-info")
    return spark.read.parquet(path), json.loads(spark.read.parquet(f"{path}-info").first()["info"])
