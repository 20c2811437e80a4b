"""Queries that fit a model and draw from it; rows follow the seed, so there is no SQL for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..models import create
from .registry import query, table


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_acctbal", "c_nationkey", "c_mktsegment")


def _draw(name: str, n: int = 500, **parameters):
    def run(spark, sf_dir):
        return create(name, seed=7, **parameters).fit(_customers(spark, sf_dir)).sample(n)

    run.__name__ = f"{name}_sample"
    run.__module__ = __name__
    return query()(run)


for _name in ("marginals", "gaussian_copula", "bayesian_network", "private_marginals", "smote", "cart", "private_cart", "langevin"):
    _draw(_name)


@query("with n as (select c_acctbal, c_nationkey, c_mktsegment, row_number() over (order by c_acctbal, c_nationkey, c_mktsegment) - 1 i from customer) select c_acctbal, c_nationkey, c_mktsegment from range(500) r(k) join n on i = k % (select count(*) from customer)")
def identity_sample(spark, sf_dir):
    return create("identity").fit(_customers(spark, sf_dir)).sample(500)


@query("select count(*) as n, cast(1 as bigint) as n_segments from range(300)")
def conditional_sample(spark, sf_dir):
    rows = create("gaussian_copula", seed=3).fit(_customers(spark, sf_dir)).sample(300, {"c_mktsegment": "BUILDING"})
    return rows.agg(F.count("*").alias("n"), F.count_distinct("c_mktsegment").alias("n_segments"))
