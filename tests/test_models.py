import numpy as np
import pytest
from pyspark.sql import functions as F

from synthframe import models
from synthframe.cli import run_task
from synthframe.models.base import load_model
from synthframe.operators import neighbors
from synthframe.operators.sample import bootstrap


@pytest.fixture(scope="module")
def people(spark):
    rows = [(20 + i % 50, 1000.0 + 37.5 * (i % 50) + i % 7 if i % 13 else None, "ABCD"[i % 4] if i % 17 else None, i % 3 == 0) for i in range(150)]
    return spark.createDataFrame(rows, "age int, income double, city string, married boolean")


@pytest.mark.parametrize("name", models.registered())
def test_model_contract(people, name):
    model = models.create(name, seed=3).fit(people)
    rows = model.sample(61)
    assert rows.columns == people.columns and dict(rows.dtypes) == dict(people.dtypes)
    got = sorted(map(str, rows.collect()))
    assert len(got) == 61 and got == sorted(map(str, model.sample(61).collect()))
    known = {r[0] for r in people.select("city").distinct().collect()}
    assert {r[0] for r in rows.select("city").distinct().collect()} <= known
    assert {r[0] for r in model.sample(5, {"city": "B"}).select("city").collect()} == {"B"}


def test_copula_keeps_the_correlation(people):
    rows = models.create("gaussian_copula", seed=1).fit(people.dropna()).sample(2000)
    assert rows.agg(F.corr("age", "income")).first()[0] > 0.9


def test_langevin_steps_on_all_rows(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(3000, 2)), rng.normal(size=(3000, 2)) + 6])
    rows = spark.createDataFrame([(float(a), float(b), "LR"[k // 3000]) for k, (a, b) in enumerate(x)], "x double, id double, side string")
    model = models.create("langevin", seed=2, steps=3, size=0.3).fit(rows)
    got = model.sample(80).orderBy("x").toPandas()
    # the same steps on the whole matrix, from the same drawn rows and noise
    own = bootstrap(rows, 80, rows.columns, 2).orderBy("sample_id").toPandas()
    scale = np.array(model.state["scale"])
    t, y = (x - scale[:, 0]) / scale[:, 1], (own[["x", "id"]].to_numpy() - scale[:, 0]) / scale[:, 1]
    side = np.repeat(["L", "R"], 3000)
    draws = np.stack([np.random.default_rng([2, int(i)]).normal(size=(4, 2)) for i in own["sample_id"]])
    y = y + 0.01 * draws[:, 0]
    same = own["side"].to_numpy()[:, None] == side[None, :]
    for s in range(3):
        away = y[:, None, :] - t[None, :, :]
        d = np.linalg.norm(away, axis=2)
        unit = away / np.maximum(d, 1e-12)[:, :, None]
        grad = unit[np.arange(80), d.argmin(1)] + (unit * same[:, :, None]).sum(1) / (same.sum(1) + 1e-6)[:, None]
        y = y - 0.3 * grad + np.sqrt(0.6) * 0.01 * draws[:, s + 1]
    target = side[np.linalg.norm(y[:, None, :] - t[None, :, :], axis=2).argmin(1)]
    y = y * scale[:, 1] + scale[:, 0]
    order = y[:, 0].argsort()
    assert np.allclose(got[["x", "id"]].to_numpy(), y[order], atol=1e-6) and got["side"].tolist() == target[order].tolist()
    monkeypatch.setattr(neighbors, "WAVE", 2500)
    again = model.sample(80).orderBy("x").toPandas()
    assert np.allclose(again[["x", "id"]], got[["x", "id"]], atol=1e-6) and again["side"].tolist() == got["side"].tolist()


def test_save_and_load(spark, people, tmp_path):
    folder = "file://" + str(tmp_path / "m")
    model = models.create("bayesian_network", seed=5, bins=6).fit(people)
    model.save(folder)
    again = load_model(spark, folder)
    assert sorted(map(str, again.sample(40).collect())) == sorted(map(str, model.sample(40).collect()))


def test_edit_registry_and_errors(people):
    model = models.create("marginals").fit(people)
    assert {tuple(r) for r in model.edit(people.limit(1), {"city": "C"}, 3).select("age", "city").collect()} == {(20, "C")}
    with pytest.raises(ValueError):
        models.create("nope")
    with pytest.raises(TypeError):
        models.register("bad", dict)
    with pytest.raises(RuntimeError):
        models.create("smote").sample(1)


def test_single_and_constant_columns(spark):
    one = spark.createDataFrame([("a",), ("b",)], "c string")
    same = spark.createDataFrame([(1.0, "x")] * 20, "n double, s string")
    for name in ("marginals", "gaussian_copula", "bayesian_network"):
        assert models.create(name).fit(one).sample(7).count() == 7
        assert {tuple(r) for r in models.create(name).fit(same).sample(5).collect()} == {(1.0, "x")}


def test_task_reports_failures(spark, people, tmp_path):
    folder = "file://" + str(tmp_path)
    assert run_task(spark, "people", people, "marginals", {}, 30, folder)["rows"] == 30
    assert run_task(spark, "people", people, "nope", {}, 30, folder)["status"] == "failed"


@pytest.mark.parametrize("name", ["cart", "private_cart"])
def test_loaded_trees_draw_what_the_fitted_ones_do(spark, tmp_path, name):
    rows = spark.createDataFrame([(i % 5 * 1.5, f"level {i % 150}", "ab"[i % 2]) for i in range(600)], "x double, many string, few string")
    model = models.create(name, seed=4).fit(rows)
    model.save(str(tmp_path / name))
    loaded = load_model(spark, str(tmp_path / name))
    assert sorted(map(tuple, loaded.sample(60).collect())) == sorted(map(tuple, model.sample(60).collect()))


@pytest.mark.parametrize("name", ["marginals", "gaussian_copula"])
def test_all_of_many_levels_can_be_drawn(spark, name, tmp_path):
    df = spark.range(3000).selectExpr("case when id % 3 = 0 then 'hot' else lpad(cast(id as string), 5, '0') end as t", "cast(id as double) as x")
    model = models.create(name, seed=4).fit(df)
    drawn = model.sample(2000)
    values = drawn.select("t").distinct().count()
    assert drawn.count() == 2000 and values > 700 and drawn.join(df, "t", "left_anti").count() == 0
    assert 550 < drawn.where("t = 'hot'").count() < 800
    if name == "gaussian_copula":
        rank = drawn.where("t <> 'hot'").selectExpr("corr(cast(t as double), x) as r").first()["r"]
        assert rank > 0.3  # a third of the rows, the hot ones, have any x
    model.save(f"file://{tmp_path}/m")
    assert load_model(spark, f"file://{tmp_path}/m").sample(2000).exceptAll(drawn).count() == 0


def test_smote_looks_for_neighbours_of_drawn_rows_only(spark):
    # one search over all pairs of 150,000 rows would take minutes
    rows = spark.range(150_000).selectExpr("cast(pmod(xxhash64(id), 30000) as double) as x", "cast(pmod(xxhash64(id, 1), 10) as double) as y", "concat('c', id % 3) as c")
    model = models.create("smote", seed=1).fit(rows)
    assert "near" not in model.tables and model.tables["points"].count() == 150_000
    drawn = model.sample(200)
    assert drawn.count() == 200 and drawn.where("x between 0 and 30000 and y between 0 and 9 and c in ('c0', 'c1', 'c2')").count() == 200


@pytest.mark.parametrize("copies", [1, 9])
def test_few_queries_find_the_nearest_of_many_rows(spark, copies):
    rng = np.random.default_rng(copies)
    x = np.tile(rng.normal(size=(2700 // copies, 3)).round(2), (copies, 1)) + 50
    c = np.array([["a", "b", None][i % 3] for i in range(len(x))], object)
    base = spark.createDataFrame([(i, x[i].tolist(), c[i]) for i in range(len(x))], "id long, v array<double>, c string").repartition(5)
    asked = range(0, len(x), 11)
    for label in ("c", None):
        got = neighbors.nearest(base.where("id % 11 = 0"), base, 4, id_column="id", vector="v", label=label, exclude_self=True).orderBy("id", "rank").collect()
        want = []
        for i in asked:
            others = [j for j in range(len(x)) if j != i and (label is None or c[i] == c[j])]
            d = ((x[others] - x[i]) ** 2).sum(1)
            want += [(i, others[j], rank + 1) for rank, j in enumerate(np.lexsort((others, d))[:4])]
        assert [(r["id"], r["near_id"], r["rank"]) for r in got] == want
