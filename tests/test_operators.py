import math

import pytest
from pyspark.sql import functions as F

from synthframe.config import load_profile
from synthframe.functions.ordered import running_sums, with_row_number
from synthframe.operators import clean, encode, features, infer, metrics, neighbors, profile, sample, split
from synthframe.sources import files


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(i, float(i % 7) if i % 9 else None, "ABC"[i % 3] if i % 11 else None, i % 2 == 0, 42, "x") for i in range(60)]
    return spark.createDataFrame(rows, "id long, num double, cat string, flag boolean, always long, constant string")


def test_plan_round_trip_keeps_names_order_types_and_nulls(mixed):
    df = mixed.select("num", "cat", "flag", "always", "constant").where("num is not null")
    plan = encode.TablePlan.from_json(encode.fit_plan(df).to_json())
    back = encode.decode(encode.encode(df, plan), plan)
    assert back.dtypes == df.dtypes
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert encode.encode(df, plan).columns == plan.encoded_names


def test_unicode_names_and_values(spark):
    df = spark.createDataFrame([(1.0, "ü"), (2.0, "日本"), (3.0, "")], "`价格` double, `schön_ü` string")
    plan = encode.fit_plan(df)
    assert sorted(encode.decode(encode.encode(df, plan), plan).collect()) == sorted(df.collect())


def test_empty_string_is_a_category(spark):
    df = spark.createDataFrame([("",), ("a",), (None,)], "label string")
    assert [r["value"] for r in encode.level_table(df, "label").orderBy("code").collect()] == ["", "a"]


def test_label_codes_null_is_minus_one_and_decodes_to_null(mixed):
    coded = encode.label_codes(mixed, "cat", "code")
    assert coded.where("cat is null and code <> -1").count() == 0
    back = encode.decode_codes(coded.select("id", "code"), "code", encode.level_table(mixed, "cat"), "cat")
    assert back.where("code = -1 and cat is not null").count() == 0
    assert sorted(map(str, back.select("id", "cat").collect())) == sorted(map(str, mixed.select("id", "cat").collect()))


def test_minmax_of_a_constant_is_zero(mixed):
    plan = encode.fit_plan(mixed.select("always"))
    assert {r[0] for r in encode.encode(mixed.select("always"), plan).collect()} == {0.0}


def test_quantile_inverse(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("x"))
    knots = encode.quantile_knots(df, "x", 11)
    back = encode.quantile_transform(df, "x", 11).select("x", encode.inverse_quantile(F.col("x_u"), knots).alias("y"))
    assert back.where("abs(x - y) > 1e-9").count() == 0


def test_profiles_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a double, b string")
    assert profile.numeric_profile(df).first()["n"] == 0
    assert {r["n_rows"] for r in profile.null_profile(df).collect()} == {0}
    assert metrics.mutual_information(spark.createDataFrame([], "a string, b string"), ["a", "b"]).count() == 0


def test_drops(mixed):
    assert clean.drop_constant(mixed).columns == ["id", "num", "cat", "flag"]
    with pytest.raises(ValueError):
        clean.drop_null_numbers(mixed.withColumn("split", F.lit("test")), ["num"], "split")


def test_reserved_names(spark):
    df = spark.createDataFrame([(1, 2)], "value int, other int")
    renamed, back = clean.rename_reserved(df)
    assert renamed.withColumnsRenamed(back).columns == df.columns and "value" not in renamed.columns


def test_targets(mixed):
    assert infer.pick_target(mixed) == "constant"
    assert infer.pick_target(mixed, "LAST_COLUMN") == "flag"
    with pytest.raises(ValueError):
        infer.pick_target(mixed, "nope")


def test_row_numbers_and_running_sums(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x"), F.lit(1).alias("n")).repartition(7)
    numbered = with_row_number(df, ["x"])
    assert [r["row_id"] for r in numbered.orderBy("x").collect()] == list(range(1000))
    t = running_sums(df, "x", ["n"]).orderBy("x").collect()
    assert [r["cum_n"] for r in t] == list(range(1, 1001)) and t[0]["next_x"] == t[1]["x"] and t[-1]["next_x"] is None


def test_splits_are_repeatable_and_keep_levels(mixed):
    a, b = (split.hash_split(mixed, ["id"]).orderBy("id").collect() for _ in range(2))
    assert a == b
    s = split.category_preserving_split(mixed, ["cat", "flag"], ["id"], 0.3)
    assert infer.unseen_categories(s.where("split = 'train'"), s.where("split = 'test'"), ["cat", "flag"]).count() == 0
    sizes = [r["count"] for r in split.even_shards(mixed, ["id"], 7).groupBy("shard").count().orderBy("shard").collect()]
    assert sizes == [9, 9, 9, 9, 8, 8, 8]


def test_samples_have_exactly_n_rows(mixed):
    assert sample.cycle(mixed, 130, ["id"]).count() == 130
    one, two = (sorted(map(str, sample.bootstrap(mixed, 77, ["id"], 5).collect())) for _ in range(2))
    assert len(one) == 77 and one == two
    assert sample.empirical_draw(mixed, "cat", 50, 1).count() == 50
    assert sample.condition_vectors(mixed, ["cat", "flag"], 40, 1).count() == 40
    with pytest.raises(ValueError):
        sample.overwrite(mixed, {"nope": 1})


def test_nearest_with_ties_takes_the_smaller_id(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.0])], "id long, v array<double>")
    got = neighbors.nearest(df, df, 1, id_column="id", vector="v", exclude_self=True).orderBy("id").collect()
    assert [(r["id"], r["near_id"], r["distance"]) for r in got] == [(1, 2, 1.0), (2, 1, 1.0), (3, 1, 1.0)]


def test_metrics_of_equal_tables(mixed):
    df = mixed.where("num is not null and cat is not null")
    assert metrics.wasserstein(df, df, ["num"]).first()["wasserstein"] == 0
    assert metrics.tv_complement(df, df, ["cat"]).first()["score"] == 1
    assert metrics.jensen_shannon(df, df, ["cat"]).first()["js"] == 0


def test_bad_lists_and_times(spark):
    df = spark.createDataFrame([("[1, 2, 2]", "2024-01-06 10:00:00"), ("[]", "nonsense"), ("oops", None)], "ids string, ts string")
    got = features.segment_features(df, ["ids"], 1, 2).collect()
    assert [r["num_segments"] for r in got] == [3, 0, 0] and [r["seg_2"] for r in got] == [1, 0, 0]
    t = features.time_features(df, "ts").collect()
    assert t[0]["is_weekend"] == 1 and t[0]["dow"] == 5 and t[1]["hour"] is None


def test_vocabulary_threshold_and_missing(spark):
    df = spark.createDataFrame([("a",)] * 30 + [("b",)] * 29 + [(None,)], "c string")
    counts = {r["c"]: r["count"] for r in features.vocabulary_column(df, "c", 30).groupBy("c").count().collect()}
    assert counts == {"a": 30, features.OTHER: 29, features.MISSING: 1}


def test_whole_preprocessing(spark):
    df = spark.range(200).selectExpr("id", "cast(timestamp_seconds(id * 3600) as string) as event_time", "case when id % 2 = 0 then 'MyApp' else 'shop.com' end as site", "concat('[', id % 5, ']') as ids", "id * 1.5 as total", "id % 3 * 1.0 as fee")
    out = features.preprocess(df, drop=["id"], time="event_time", site="site", segments=["ids"], total="total", parts=["fee"])
    assert out.count() == 200 and "event_time" not in out.columns and "log_total" in out.columns
    assert all(r["n_null"] == 0 for r in profile.null_profile(out).collect())


def test_files(spark, tmp_path, mixed):
    folder = "file://" + str(tmp_path)
    with pytest.raises(FileNotFoundError):
        files.load(spark, f"{folder}/none.csv")
    df = mixed.select("id", "num", "cat")
    for kind in ("csv", "parquet"):
        files.save_samples(df, folder, f"s_{kind}", kind, {"model": "identity"})
        back = files.load_samples(spark, folder, f"s_{kind}")
        assert back.dtypes == df.dtypes and back.count() == 60
    assert files.load_samples(spark, folder, "nothing") is None
    assert files.list_samples(spark, folder) == ["s_csv", "s_parquet"]
    with pytest.raises(ValueError):
        files.save_samples(df, folder, "p", "pickle")
    assert [c.count() for c in files.chunks(df, 25, ["id"])] == [25, 25, 10]
    files.write_splits(split.hash_split(df, ["id"]), f"{folder}/splits")
    assert files.read_split(spark, f"{folder}/splits", "train").columns == df.columns
    for k in range(4):
        files.write_json(spark, f"{folder}/ck/{k}.json", {"k": k})
    files.keep_latest(spark, f"{folder}/ck", 2)
    assert len(files.discover(spark, f"{folder}/ck", ".json")) == 2


def test_moments_and_epsilon(spark):
    votes = spark.createDataFrame([(9.0,), (8.0,)], "n double")
    m = metrics.moments_accountant(votes, "n", 10, 0.1, [1, 2])
    assert metrics.epsilon(m, 1e-5).first()["epsilon"] > 0
    assert math.isfinite(m.agg(F.sum("alpha")).first()[0])


def test_config(monkeypatch):
    monkeypatch.setenv("SYNTHFRAME_CART_DEPTH", "4")
    assert load_profile("quick", "cart")["depth"] == 4
    with pytest.raises(ValueError):
        load_profile("nope")
