import pytest
from pyspark.sql import functions as F

from synthframe.operators import clean, encode, infer, metrics, profile, sample, transform


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, None if i % 6 == 0 else float(i % 9), None if i % 4 == 0 else "ab"[i % 2], float(i), "test" if i % 5 == 0 else "train") for i in range(60)]
    return spark.createDataFrame(data, "id long, x double, c string, y double, split string")


def test_rules_on_an_empty_table(rows):
    empty = rows.where("id < 0")
    assert {r["role"] for r in infer.roles_by_rules(empty).where("column = 'c'").collect()} == {"categorical"}
    assert infer.tasks_by_rules(empty, ["c", "x"]).count() == 6
    assert {r["table"]: r["n_rows"] for r in profile.table_totals({"a": empty, "b": rows}).collect()} == {"a": 0, "b": 60, "ALL": 60}
    assert sample.empirical_draw(empty, "c", 5).count() == 0


def test_pad_shortens_fills_and_falls_back(rows):
    five = rows.where("id < 5")
    assert [r["id"] for r in sample.pad(five, rows, 3, ["id"]).orderBy("sample_id").collect()] == [0, 1, 2]
    filled = [r["id"] for r in sample.pad(five, rows, 12, ["id"]).orderBy("sample_id").collect()]
    assert filled[:5] == [0, 1, 2, 3, 4] and set(filled[5:]) <= set(range(5)) and len(filled) == 12
    assert sample.pad(rows.where("id < 0"), rows, 7, ["id"]).count() == 7


def test_draws_follow_counts_of_any_spread(spark):
    counts = {("a", str(v)): 1 for v in range(50)} | {("a", "hot"): 900, ("b", "only"): 3, ("b", None): 5}
    weights = spark.createDataFrame([(g, v, n) for (g, v), n in counts.items()], "g string, value string, n long")
    sizes, slots = sample.weighted_slots(weights, ["g"])
    assert slots.count() <= 3 * len(counts)
    picks = spark.createDataFrame([("a", i, i) for i in range(950)] + [("b", i, i) for i in range(8)], "g string, i long, _pick long")
    drawn = sample.draw_weighted(picks, sizes, slots, ["g"])
    assert {(r["g"], r["value"]): r["count"] for r in drawn.groupBy("g", "value").count().collect()} == counts


def test_slots_of_a_wide_value_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sample, "SLOTS", 4)
    weights = spark.createDataFrame([("g", str(v), 100 if v == 7 else 1) for v in range(40)], "g string, value string, n long")
    sizes, slots = sample.weighted_slots(weights, ["g"])
    picks = spark.range(139).select(F.lit("g").alias("g"), F.col("id").alias("_pick"))
    drawn = sample.draw_weighted(picks, sizes, slots, ["g"]).groupBy("value").count()
    assert {r["value"]: r["count"] for r in drawn.collect()} == {str(v): 100 if v == 7 else 1 for v in range(40)}


def test_conditions_without_rows_take_any(spark, rows):
    asked = spark.createDataFrame([(0, "c", "a"), (1, "c", "zz"), (2, "c", None)], "sample_id long, column string, value string")
    found = {r["sample_id"]: r for r in sample.rows_for_conditions(rows, asked, ["c"], "id").collect()}
    assert found[0]["matched"] and found[0]["c"] == "a" and not found[1]["matched"] and len(found) == 3
    assert sample.rows_for_conditions(rows.where("id < 0"), asked, ["c"], "id").count() == 0


def test_transform_goes_back_and_is_kept(spark, rows, tmp_path):
    steps = transform.Transformations(normalization="minmax", missing_numbers="drop", missing_categories="none", encoding="code")
    args = (["x"], ["c"], "y", "regression")
    out, info = transform.cached_transform(rows, f"file://{tmp_path}", *args, steps=steps)
    again, same = transform.cached_transform(rows.where("id < 0"), f"file://{tmp_path}", *args, steps=steps)
    assert out.count() == 50 == again.count() and info == same and steps.key() != transform.Transformations().key()
    assert {r["y"] for r in transform.restore_target(out, "y", info).select(F.round("y", 6).alias("y")).collect()} == {float(i) for i in range(60) if i % 6}
    assert out.agg(F.min("x"), F.max("x")).first() == (0.0, 1.0) and {r["c"] for r in out.select("c").distinct().collect()} == {0, 1, 2} - ({0} if not rows.where("c = 'a'").count() else set())


def test_quantile_steps_and_classes_leave_the_target(rows):
    steps = transform.Transformations(normalization="quantile", missing_numbers="mean", missing_categories="mode")
    out, info = transform.transform_table(rows, ["x"], ["c"], "y", "binclass", steps)
    assert info == {} and out.columns == rows.columns and out.where("x is null or c is null").count() == 0
    assert transform.arrange_target(["x"], ["c"], "y", "regression") == (["y", "x"], ["c"])
    assert transform.arrange_target(["x"], ["c"], "y", "multiclass") == (["x"], ["y", "c"])


def test_generated_rows_with_holes(rows):
    assert clean.drop_invalid(rows).count() == 50
    with pytest.raises(ValueError):
        clean.drop_invalid(rows, strict=True)


def test_imputation_scores_by_hand(spark):
    truth = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, v string")
    trials = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "b"), (3, "a"), (2, "zz")], "k long, v string")
    row = metrics.imputation_scores(truth, trials, "k", "v").first()
    # cells: (1,a) .5 true, (1,b) .5, (2,b) 1 true, (2,a) 0: pairs won 3.5 of 4; the tie of row 1 goes to a
    assert row["micro_f1"] == 1.0 and row["micro_auc"] == pytest.approx(3.5 / 4)


def test_ten_thousand_levels_stay_a_table(spark):
    df = spark.range(10000).select(F.when(F.col("id") > 0, F.concat(F.lit("v"), "id")).alias("c"), F.col("id").alias("_code0"))
    plan = encode.TablePlan.from_json(encode.fit_plan(df).to_json())
    assert plan.columns[0].role == "coded" and plan.columns[0].high == 9998.0 and not plan.columns[0].levels
    coded = encode.encode(df.select("c"), encode.TablePlan(plan.columns[:1]))
    assert coded.columns == plan.encoded_names[:1] and coded.where("c_code = -1").count() == 1
    back = encode.decode(coded, encode.TablePlan(plan.columns[:1]))
    assert back.exceptAll(df.select("c")).count() == 0 and back.count() == 10000
    other = encode.encode(spark.createDataFrame([("new",)], "c string"), encode.TablePlan(plan.columns[:1]))
    assert other.first()["c_code"] == -1.0
