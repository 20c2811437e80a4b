import math

from pyspark.sql import functions as F

from synthframe.functions import kernels


def test_schedules():
    assert abs(sum(kernels.linear_betas(1000)) - 1000 * (1e-4 + 0.02) / 2) < 1e-9
    betas = kernels.cosine_betas(50)
    assert len(betas) == 50 and betas[-1] == 0.999 and all(a < b for a, b in zip(betas, betas[1:], strict=False) if b < 0.999)
    grid = kernels.sigma_grid(18)
    assert abs(grid[0] - 80) < 1e-9 and abs(grid[-2] - 0.002) < 1e-9 and grid[-1] == 0
    assert kernels.embedding_width(100) == 16 and kernels.embedding_width(10**9) == 600


def test_expressions(spark):
    df = spark.createDataFrame([(0.5, 1.5)], "a double, b double").withColumn("v", F.array("a", "b"))
    row = df.select(
        kernels.log_add_exp(F.col("a"), F.col("b")).alias("lae"), kernels.log_sum_exp(F.col("v")).alias("lse"), kernels.argmax(kernels.log_one_hot(F.lit(1), 3)).alias("hot"),
        kernels.softmax(F.col("v")).alias("p"), kernels.normal_kl(F.col("a"), F.lit(0.0), F.col("a"), F.lit(0.0)).alias("kl"), kernels.tanh_normal_cdf(F.lit(0.0)).alias("half"), kernels.log_one_minus_exp(F.lit(-1.0)).alias("l1"),
    ).first()
    want = math.log(math.exp(0.5) + math.exp(1.5))
    assert abs(row["lae"] - want) < 1e-12 and abs(row["lse"] - want) < 1e-12 and row["hot"] == 1
    assert abs(sum(row["p"]) - 1) < 1e-12 and row["kl"] == 0 and row["half"] == 0.5 and abs(row["l1"] - math.log(1 - math.exp(-1))) < 1e-12
