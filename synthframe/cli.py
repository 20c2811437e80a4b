"""python -m synthframe.cli MODEL INPUT OUTPUT_FOLDER -n ROWS: fit a model to a table and write synthetic rows with a report."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession

from .config import load_profile
from .models import create
from .operators.metrics import column_shapes, schema_checks
from .operators.profile import numeric_columns, string_columns
from .sources.files import load, save_samples


def run_task(spark: SparkSession, dataset: str, df: DataFrame, model: str, parameters: dict, n: int, folder: str) -> dict:
    """What became of one model on one table; errors are reported, not raised."""
    began = time.time()
    try:
        rows = create(model, **parameters).fit(df).sample(n)
        path = save_samples(rows, folder, f"{dataset}_{model}", metadata={"model": model, "parameters": parameters, "rows": n})
        rows = spark.read.parquet(path)
        scores = [r["score"] for r in column_shapes(df, rows, numeric_columns(df), string_columns(df)).collect() if r["score"] is not None]
        facts = {"status": "ok", "path": path, "rows": rows.count(), "quality": sum(scores) / len(scores) if scores else None} | schema_checks(df, rows)
    except Exception as e:  # the task's contract
        facts = {"status": "failed", "error": f"{type(e).__name__}: {e}"}
    return {"dataset": dataset, "model": model, "seconds": time.time() - began} | facts


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("model")
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("-n", type=int, default=1000)
    p.add_argument("--profile", default="default")
    p.add_argument("--seed", type=int, default=0)
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("synthframe").getOrCreate()
    name = a.input.rstrip("/").rsplit("/", 1)[-1].split(".")[0]
    result = run_task(spark, name, load(spark, a.input), a.model, load_profile(a.profile, a.model) | {"seed": a.seed}, a.n, a.output)
    print(result)
    return 0 if result["status"] == "ok" else 1


if __name__ == "__main__":
    raise SystemExit(main())
