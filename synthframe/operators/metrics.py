"""Fidelity, correlation, prediction and privacy metrics as aggregates over small contingency or distribution tables."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import running_sums


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def _text(c: str) -> Column:
    return _q(c).cast("string")


def contingency(df: DataFrame, columns: Sequence[str], both_ways: bool = False) -> DataFrame:
    """a, b, va, vb, n of all column pairs: one pass, partial counts before the shuffle; NULL is a level."""
    names = [(a, b) for a, b in combinations(columns, 2)]
    names += [(b, a) for a, b in names] if both_ways else []
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), _text(a).alias("va"), _text(b).alias("vb")) for a, b in names])
    return df.select(F.explode(cells).alias("r")).select("r.*").groupBy("a", "b", "va", "vb").agg(F.count("*").alias("n"))


def _with_margins(table: DataFrame) -> DataFrame:
    over = Window.partitionBy("a", "b")
    return table.select(
        "*",
        F.sum("n").over(Window.partitionBy("a", "b", "va")).cast("double").alias("na"),
        F.sum("n").over(Window.partitionBy("a", "b", "vb")).cast("double").alias("nb"),
        F.sum("n").over(over).cast("double").alias("nn"),
    )


def mutual_information(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, mi (natural log) of all pairs of discrete columns."""
    t = _with_margins(contingency(df, columns))
    return t.groupBy("a", "b").agg(F.sum(F.col("n") / F.col("nn") * F.ln(F.col("n") * F.col("nn") / (F.col("na") * F.col("nb")))).alias("mi"))


def dependency_order(mi: DataFrame, columns: Sequence[str]) -> list[str]:
    """Greedy order: the column with the largest total mutual information first, then whichever shares most with one
    already chosen; ties in the order of columns. Works on the columns-by-columns table."""
    m = {c: {} for c in columns}
    for r in mi.collect():
        m[r["a"]][r["b"]] = m[r["b"]][r["a"]] = r["mi"]
    order = [max(columns, key=lambda c: (sum(m[c].values()), -columns.index(c)))]
    while len(order) < len(columns):
        rest = [c for c in columns if c not in order]
        order.append(max(rest, key=lambda c: (max(m[c].get(o, 0.0) for o in order), -columns.index(c))))
    return order


def maximum_spanning_tree(mi: DataFrame, columns: Sequence[str]) -> list[tuple[str | None, str]]:
    """(parent, child) of the Chow-Liu tree, parents first; the root has no parent."""
    weight = {}
    for r in mi.collect():
        weight[r["a"], r["b"]] = weight[r["b"], r["a"]] = r["mi"]
    tree: list[tuple[str | None, str]] = [(None, columns[0])]
    while len(tree) < len(columns):
        known = [c for _, c in tree]
        tree.append(max(((p, c) for p in known for c in columns if c not in known), key=lambda e: (weight.get(e, 0.0), -columns.index(e[0]), -columns.index(e[1]))))
    return tree


def theils_u(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, u = (H(a) - H(a | b)) / H(a), 1 where a doesn't vary; both directions."""
    t = _with_margins(contingency(df, columns, both_ways=True))
    given = F.sum(F.col("n") / F.col("nn") * F.ln(F.col("nb") / F.col("n")))
    own = F.sum(F.col("n") / F.col("nn") * F.ln(F.col("nn") / F.col("na")))
    return t.groupBy("a", "b").agg(F.when(own < 1e-12, F.lit(1.0)).otherwise((own - given) / own).alias("u"))


def correlation_ratio(df: DataFrame, categories: Sequence[str], numbers: Sequence[str], root: bool = False) -> DataFrame:
    """category, number, eta2 = between-group / total sum of squares (0 if nothing lies between); its root if asked."""
    cells = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(x).alias("number"), _text(c).alias("v"), _q(x).cast("double").alias("y")) for c in categories for x in numbers])
    groups = df.select(F.explode(cells).alias("r")).select("r.*").where("y is not null").groupBy("category", "number", "v").agg(F.count("*").alias("n"), F.avg("y").alias("m"), F.sum(F.col("y") * F.col("y")).alias("ss"))
    n, mean = F.sum("n"), F.sum(F.col("n") * F.col("m")) / F.sum("n")
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) - n * mean * mean
    total = F.sum("ss") - n * mean * mean
    ratio = F.when((between <= 0) | (total <= 0), F.lit(0.0)).otherwise(between / total)
    return groups.groupBy("category", "number").agg((F.sqrt(ratio) if root else ratio).alias("eta2"))


def pearson_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, r of all pairs, from one aggregate."""
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(_q(a).cast("double"), _q(b).cast("double")).alias("r")) for a, b in combinations(columns, 2)]
    return df.agg(F.array(*cells).alias("m")).select(F.explode("m").alias("x")).select("x.*")


def matrix_gap(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """gap: Frobenius norm of the difference of two long matrices; NaN and NULL count as 0."""
    clean = lambda c: F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))
    both = left.withColumnRenamed(value, "_x").join(right.withColumnRenamed(value, "_y"), list(keys))
    return both.agg(F.sqrt(F.sum(F.pow(clean(F.col("_x")) - clean(F.col("_y")), 2))).alias("gap"))


def _cdf_table(real: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, x, next_x, fr, fs: both distribution functions at each distinct value."""

    def long(df: DataFrame, r: int, s: int) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(c).alias("column"), _q(c).cast("double").alias("x")) for c in columns])
        return df.select(F.explode(cells).alias("c")).select("c.*").where("x is not null and not isnan(x)").select("column", "x", F.lit(r).alias("nr"), F.lit(s).alias("ns"))

    counts = long(real, 1, 0).union(long(synthetic, 0, 1)).groupBy("column", "x").agg(F.sum("nr").alias("nr"), F.sum("ns").alias("ns"))
    t = running_sums(counts, "x", ["nr", "ns"], ["column"])
    return t.select("column", "x", "next_x", F.try_divide("cum_nr", "total_nr").alias("fr"), F.try_divide("cum_ns", "total_ns").alias("fs"))


def wasserstein(real: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, wasserstein: area between the distribution functions of each numeric column."""
    area = F.abs(F.col("fr") - F.col("fs")) * (F.coalesce("next_x", "x") - F.col("x"))
    return _cdf_table(real, synthetic, columns).groupBy("column").agg(F.sum(area).alias("wasserstein"))


def ks_complement(real: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, score: 1 - largest gap between the distribution functions."""
    return _cdf_table(real, synthetic, columns).groupBy("column").agg((1 - F.max(F.abs(F.col("fr") - F.col("fs")))).alias("score"))


def _histograms(real: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, value, p, q: shares of each level on both sides."""

    def long(df: DataFrame, r: int, s: int) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(c).alias("column"), _text(c).alias("value")) for c in columns])
        return df.select(F.explode(cells).alias("c")).select("c.*").where("value is not null").select("column", "value", F.lit(r).alias("r"), F.lit(s).alias("s"))

    counts = long(real, 1, 0).union(long(synthetic, 0, 1)).groupBy("column", "value").agg(F.sum("r").alias("r"), F.sum("s").alias("s"))
    over = Window.partitionBy("column")
    return counts.select("column", "value", F.try_divide(F.col("r"), F.sum("r").over(over)).alias("p"), F.try_divide(F.col("s"), F.sum("s").over(over)).alias("q"))


def jensen_shannon(real: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, js: root of the Jensen-Shannon divergence (natural log) of the histograms."""
    m = (F.col("p") + F.col("q")) / 2
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.ln(F.col(x) / m)).otherwise(0.0)
    return _histograms(real, synthetic, columns).groupBy("column").agg(F.sqrt(F.greatest(F.lit(0.0), F.sum(part("p") + part("q")) / 2)).alias("js"))


def tv_complement(real: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, score: 1 - half the sum of differences of the histograms."""
    return _histograms(real, synthetic, columns).groupBy("column").agg((1 - F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("score"))


def column_shapes(real: DataFrame, synthetic: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """column, score: KS complement of numbers, TV complement of the others."""
    return ks_complement(real, synthetic, numeric).union(tv_complement(real, synthetic, categorical))


def rank_models(scores: DataFrame, worst: float = 3.0) -> DataFrame:
    """Of (model, column, score): model, mean_rank. Runs are averaged, each column's models ranked by score from 1 (ties by
    name), NaN scores rank `worst`."""
    mean = scores.groupBy("model", "column").agg(F.avg("score").alias("score"))
    order = Window.partitionBy("column").orderBy("score", "model")
    ranks = mean.withColumn("r", F.when(F.col("score").isNull() | F.isnan("score"), F.lit(worst)).otherwise(F.row_number().over(order)))
    return ranks.groupBy("model").agg(F.avg("r").alias("mean_rank"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(_text(truth).alias("truth"), _text(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def classification_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """class, support, precision, recall, f1 of each class of the truth, from the confusion table."""
    c = confusion(df, truth, predicted)
    by_truth = c.groupBy(F.col("truth").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    by_pred = c.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("claimed"))
    t = by_truth.join(by_pred, "class", "left").fillna({"claimed": 0})
    precision = F.when(F.col("claimed") > 0, F.col("hit") / F.col("claimed")).otherwise(0.0)
    recall = F.col("hit") / F.col("support")
    f1 = F.when(F.col("hit") > 0, 2.0 * F.col("hit") / (F.col("claimed") + F.col("support"))).otherwise(0.0)
    return t.select("class", "support", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def classification_scores(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """accuracy, macro_f1."""
    report = classification_report(df, truth, predicted)
    return report.agg(F.try_divide(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"))


def roc_auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """auc of a 0/1 truth by a score; ties count one half. Works on distinct scores, with running sums by range."""
    counts = df.where(_q(score).isNotNull() & _q(truth).isNotNull()).groupBy(_q(score).cast("double").alias("x")).agg(F.sum((_q(truth) == 1).cast("long")).alias("p"), F.sum((_q(truth) == 0).cast("long")).alias("n"))
    t = running_sums(counts, "x", ["p", "n"])
    wins = F.sum(F.col("p") * (F.col("cum_n") - F.col("n") / 2))
    return t.agg(F.try_divide(wins, F.first("total_p") * F.first("total_n")).alias("auc"))


def regression_scores(df: DataFrame, truth: str, predicted: str, std: float = 1.0) -> DataFrame:
    """rmse (times std) and r2."""
    y, e = _q(truth).cast("double"), _q(truth).cast("double") - _q(predicted).cast("double")
    return df.agg((F.sqrt(F.avg(e * e)) * F.lit(std)).alias("rmse"), (1 - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(y))).alias("r2"))


def seeds_report(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """count, mean and population deviation of a metric over runs."""
    return df.groupBy(*group).agg(F.count(_q(value)).alias("count"), F.avg(_q(value)).alias("mean"), F.stddev_pop(_q(value)).alias("std"))


def schema_checks(real: DataFrame, synthetic: DataFrame) -> dict[str, bool]:
    return {"columns_match": real.columns == synthetic.columns, "types_match": dict(real.dtypes) == dict(synthetic.dtypes)}


def pate_votes(votes: DataFrame, row: str, vote: str, teachers: int, lam: float | None = None, seed: int = 0) -> DataFrame:
    """row, n_yes, label: summed 0/1 votes, with Laplace noise of scale 1 / lam if given, above half of the teachers."""
    from .sample import uniform

    total = votes.groupBy(_q(row)).agg(F.sum(_q(vote)).cast("double").alias("n_yes"))
    if lam:
        u = uniform(seed, _q(row)) - 0.5
        total = total.withColumn("n_yes", F.col("n_yes") - F.signum(u) * F.ln(1 - 2 * F.abs(u)) / lam)
    return total.withColumn("label", (F.col("n_yes") > teachers / 2).cast("int"))


def moments_accountant(votes: DataFrame, n_yes: str, teachers: int, lam: float, orders: Sequence[int]) -> DataFrame:
    """l, alpha: for each moment order the summed bound of the noisy vote's privacy loss, over rows of votes.

    With q the chance that noise flips a row's vote, (2 + g) / (4 e^g) for g = lam |yes - no|, a row adds the smaller of
    2 lam^2 l (l + 1) and ln((1 - q) ((1 - q) / (1 - q e^(2 lam)))^l + q e^(2 lam l))."""
    g = F.lit(lam) * F.abs(2 * _q(n_yes) - F.lit(float(teachers)))
    q = (2 + g) / (4 * F.exp(g))
    cells = []
    for order in orders:
        flat = F.lit(2.0 * lam * lam * order * (order + 1))
        tight = F.when(q * F.exp(F.lit(2 * lam)) < 1, F.ln((1 - q) * F.pow((1 - q) / (1 - q * F.exp(F.lit(2 * lam))), F.lit(float(order))) + q * F.exp(F.lit(2 * lam * order))))
        cells.append(F.struct(F.lit(order).alias("l"), F.least(flat, F.coalesce(tight, flat)).alias("a")))
    return votes.select(F.explode(F.array(*cells)).alias("c")).select("c.*").groupBy("l").agg(F.sum("a").alias("alpha"))


def epsilon(moments: DataFrame, delta: float) -> DataFrame:
    return moments.agg(F.min((F.col("alpha") - F.lit(float(math.log(delta)))) / F.col("l")).alias("epsilon"))


def marginals(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, va, vb, n, share: two-way marginals of all pairs."""
    return contingency(df, columns).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("a", "b")))




def score_parts(df: DataFrame, part: str, truth: str, predicted: str, task: str) -> DataFrame:
    """part, metric, score: higher is better whatever the task, so accuracy for classes and minus rmse for regression."""
    if task == "regression":
        error = _q(truth).cast("double") - _q(predicted).cast("double")
        return df.groupBy(_q(part).alias("part")).agg(F.lit("rmse").alias("metric"), (-F.sqrt(F.avg(error * error))).alias("score"))
    hit = _q(truth).eqNullSafe(_q(predicted)).cast("double")
    return df.groupBy(_q(part).alias("part")).agg(F.lit("accuracy").alias("metric"), F.avg(hit).alias("score"))


def rank_runs(runs: DataFrame) -> DataFrame:
    """Of (model, success, duration): model, n_runs, success_rate, duration (mean of its successful runs), rank (from 1, the
    fastest first, ties by name; NULL for a model without a success)."""
    by = runs.groupBy("model").agg(F.count("*").alias("n_runs"), F.avg(F.col("success").cast("double")).alias("success_rate"), F.avg(F.when(F.col("success"), F.col("duration"))).alias("duration"))
    order = Window.orderBy(F.col("duration").asc_nulls_last(), "model")  # one row a model
    return by.withColumn("rank", F.when(F.col("duration").isNotNull(), F.row_number().over(order)))


def table_quality(real: DataFrame, synthetic: DataFrame, train: DataFrame) -> DataFrame:
    """columns_match (as sets), types_preserved (columns of real that keep their type), n_real, n_synthetic, n_train,
    train_ratio, n_categorical."""
    kept = dict(synthetic.dtypes)
    counts = [d.agg(F.count(F.lit(1)).alias(n)) for d, n in ((real, "n_real"), (synthetic, "n_synthetic"), (train, "n_train"))]
    row = counts[0].join(F.broadcast(counts[1]), F.lit(True)).join(F.broadcast(counts[2]), F.lit(True))  # one row each
    return row.select(
        F.lit(set(real.columns) == set(synthetic.columns)).alias("columns_match"),
        F.lit(sum(kept.get(c) == t for c, t in real.dtypes)).cast("long").alias("types_preserved"),
        "n_real",
        "n_synthetic",
        "n_train",
        F.try_divide("n_train", "n_real").alias("train_ratio"),
        F.lit(sum(t in ("string", "boolean") for _, t in real.dtypes)).cast("long").alias("n_categorical"),
    )


def imputation_scores(truth: DataFrame, trials: DataFrame, key: str, value: str) -> DataFrame:
    """micro_f1, micro_auc of several imputations (key, value a trial) against the truth (key, value); the classes are those
    of the truth, and rows without a trial or a true value aren't scored.

    A row's probabilities are its trials' shares; the largest is its prediction, ties to the smaller class. The area is that
    over all (row, class) cells; those that no trial names and that aren't true are counted, not made."""
    t = truth.where(_q(value).isNotNull()).select(_q(key).alias("k"), _text(value).alias("v"))
    classes = t.select("v").distinct()
    votes = trials.select(_q(key).alias("k"), _text(value).alias("v")).join(classes, "v", "left_semi").groupBy("k", "v").agg(F.count("*").alias("n"))
    shares = votes.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("k"))).join(t.withColumnRenamed("v", "true"), "k")
    rows = shares.groupBy("k", "true").agg(F.sum(F.when(F.col("v") == F.col("true"), F.col("p")).otherwise(0.0)).alias("own"), F.count("*").alias("cells"), F.min_by("v", F.struct(-F.col("p"), F.col("v"))).alias("best"))
    rows = rows.withColumn("hit", (F.col("best") == F.col("true")).cast("double"))
    facts = rows.agg(F.avg("hit").alias("micro_f1"), F.count("*").alias("r"), F.sum("cells").alias("cells"), F.count_if(F.col("own") == 0).alias("bare"))
    facts = facts.join(F.broadcast(classes.agg(F.count("*").alias("c"))), F.lit(True))  # one row each
    cells = shares.select("p", (F.col("v") == F.col("true")).alias("is_true")).groupBy("p").agg(F.count_if("is_true").alias("pos"), F.count_if(~F.col("is_true")).alias("neg"))
    unnamed = facts.select(F.lit(0.0).alias("p"), F.col("bare").alias("pos"), (F.col("r") * F.col("c") - F.col("cells") - F.col("bare")).alias("neg"))
    counts = cells.union(unnamed).groupBy("p").agg(F.sum("pos").cast("long").alias("pos"), F.sum("neg").cast("long").alias("neg"))
    ranked = running_sums(counts, "p", ["pos", "neg"])
    wins = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2))
    area = ranked.agg(F.try_divide(wins, F.first("total_pos") * F.first("total_neg")).alias("micro_auc"))
    return facts.select("micro_f1").join(F.broadcast(area), F.lit(True))  # one row each
