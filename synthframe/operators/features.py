"""Feature engineering: times, list columns, vocabularies, cost shares and automatic numeric transforms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import drop_constant, fill_values, impute
from .infer import datetime_columns
from .profile import numeric_columns, string_columns

OTHER, MISSING = "<<OTHER>>", "na"
#: Prefixes of columns that are features already.
DONE = ("seg_", "hour_", "dow_", "cost_clr_", "log_")


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def time_features(df: DataFrame, column: str, prefix: str = "") -> DataFrame:
    """hour, dow (Monday 0), month, is_weekend, and the sine and cosine of hour and day of week; bad texts give NULL."""
    ts = F.try_to_timestamp(_q(column).cast("string"))
    hour, dow = F.hour(ts), F.weekday(ts)
    turn = 2 * 3.141592653589793

    def wave(fn, x: Column, n: int) -> Column:
        return fn(F.lit(turn) * x / F.lit(float(n)))

    return df.withColumns(
        {
            f"{prefix}hour": hour,
            f"{prefix}hour_sin": wave(F.sin, hour, 24),
            f"{prefix}hour_cos": wave(F.cos, hour, 24),
            f"{prefix}dow": dow,
            f"{prefix}dow_sin": wave(F.sin, dow, 7),
            f"{prefix}dow_cos": wave(F.cos, dow, 7),
            f"{prefix}is_weekend": (dow >= 5).cast("int"),
            f"{prefix}month": F.month(ts),
        }
    )


def site_bucket(df: DataFrame, column: str, least: int = 30, name: str = "site_bucket") -> DataFrame:
    """app where the text names an app or phone system, else web, unknown for NULL; buckets with few rows become OTHER."""
    low = F.lower(_q(column))
    bucket = F.when(_q(column).isNull(), "unknown").when(low.rlike("app|mobile|android|ios|iphone"), "app").otherwise("web")
    rows = df.withColumn(name, bucket)
    rare = [r[0] for r in rows.groupBy(name).count().where(F.col("count") < least).collect()]  # three rows at most
    return rows.withColumn(name, F.when(F.col(name).isin(*rare or [""]), OTHER).otherwise(F.col(name)))


def parse_ids(column: str) -> Column:
    """'[1, 2]' -> array of longs; what isn't a list of numbers gives an empty one."""
    text = F.trim(_q(column).cast("string"))
    inner = F.regexp_replace(text, r"^\[|\]$|\s", "")
    ids = F.transform(F.split(inner, ","), lambda x: x.try_cast("bigint"))
    good = text.rlike(r"^\[\s*(-?[0-9]+\s*(,\s*-?[0-9]+\s*)*)?\]$")
    return F.when(good, F.filter(ids, lambda x: x.isNotNull())).otherwise(F.array().cast("array<bigint>"))


def segment_features(df: DataFrame, columns: Sequence[str], top: int = 100, bins: int = 16) -> DataFrame:
    """num_segments, seg_<id> (0/1) for the most frequent ids of all rows (ties to the smaller id), seg_hash_<k> counts of ids mod bins."""
    ids = F.flatten(F.array(*[parse_ids(c) for c in columns]))
    rows = df.withColumn("_ids", ids)
    counts = rows.select(F.explode("_ids").alias("id")).groupBy("id").count()
    best = [r["id"] for r in counts.orderBy(F.desc("count"), "id").limit(top).collect()]
    out = {"num_segments": F.size("_ids")}
    out |= {f"seg_{i}": F.array_contains("_ids", F.lit(i).cast("bigint")).cast("int") for i in best}
    out |= {f"seg_hash_{k}": F.expr(f"size(filter(_ids, x -> pmod(x, {bins}) = {k}))") for k in range(bins)}
    return rows.withColumns(out).drop("_ids")


def vocabulary_column(df: DataFrame, column: str, least: int = 30, missing_is_other: bool = False) -> DataFrame:
    """Values with fewer than `least` rows become OTHER, NULL becomes MISSING (or OTHER)."""
    frequent = df.groupBy(_q(column).alias("_v")).count().where((F.col("count") >= least) & F.col("_v").isNotNull()).select("_v")
    value = F.when(_q(column).isNull(), OTHER if missing_is_other else MISSING).otherwise(F.coalesce("_v", F.lit(OTHER)))
    return df.join(frequent, _q(column) == F.col("_v"), "left").withColumn(column, value).drop("_v")


def cost_shares(df: DataFrame, total: str, parts: Sequence[str], centre: str = "column") -> DataFrame:
    """log_<total> = ln(1 + total), and cost_clr_<part>: the log of the part's share of the row's parts, centred by its
    column's mean, or with centre='row' by the row's (the centred log-ratio proper)."""
    tiny = 1e-8
    whole = sum((F.coalesce(_q(p).cast("double"), F.lit(0.0)) for p in parts), F.lit(0.0))
    whole = F.when(whole == 0, tiny).otherwise(whole)
    logs = {p: F.ln(F.coalesce(_q(p).cast("double"), F.lit(0.0)) / whole + tiny) for p in parts}
    if centre == "row":
        mean = sum(logs.values(), F.lit(0.0)) / len(parts)
        shifts = {p: mean for p in parts}
    else:
        row = df.agg(*[F.avg(x).alias(p) for p, x in logs.items()]).first()
        shifts = {p: F.lit(row[p]) for p in parts}
    return df.withColumns({f"log_{total}": F.log1p(_q(total).cast("double"))} | {f"cost_clr_{p}": logs[p] - shifts[p] for p in parts})


def transform_facts(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[str, float, float]]:
    """{column: (logit | log1p | plain, mean, sample deviation)} of the transform that fits its range; one aggregate."""
    clip = lambda x: F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), x))
    aggregates = []
    for c in columns:
        x = _q(c).cast("double")
        logit = F.ln(clip(x) / (1 - clip(x)))
        positive = F.log1p(F.when(x >= 0, x))
        aggregates.append(
            F.struct(F.min(x), F.max(x), F.avg(logit), F.stddev_samp(logit), F.avg(positive), F.stddev_samp(positive), F.avg(x), F.stddev_samp(x)).alias(c)
        )
    row = df.agg(*aggregates).first()
    out = {}
    for c in columns:
        low, high, *rest = row[c]
        kind = "plain" if low is None or low < 0 else "logit" if high <= 1 else "log1p"
        at = {"logit": 0, "log1p": 2, "plain": 4}[kind]
        out[c] = (kind, rest[at] or 0.0, rest[at + 1] or 0.0)
    return out


def auto_transform(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Numbers become z-scores: of the logit where all lie in [0, 1] (NULL counts as 0.5), of ln(1 + x) where none is
    negative (NULL as 0), else of x itself (NULL as the mean). Sample deviation, plus 1e-8; statistics leave NULLs out."""
    columns = [c for c in (columns or numeric_columns(df)) if not c.startswith(DONE)]
    if not columns:
        return df
    out = {}
    for c, (kind, mean, std) in transform_facts(df, columns).items():
        x = F.coalesce(_q(c).cast("double"), F.lit({"logit": 0.5, "log1p": 0.0, "plain": mean}[kind]))
        if kind == "logit":
            x = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), x))
            x = F.ln(x / (1 - x))
        elif kind == "log1p":
            x = F.log1p(x)
        out[c] = (x - F.lit(mean)) / F.lit(std + 1e-8)
    return df.withColumns(out)


def final_checks(df: DataFrame) -> DataFrame:
    """Numbers imputed by the median, text by the mode; constant columns dropped."""
    return drop_constant(impute(df, fill_values(df, "median", "mode")))


def preprocess(df: DataFrame, *, drop: Sequence[str] = (), time: str | None = None, site: str | None = None, segments: Sequence[str] = (), total: str | None = None, parts: Sequence[str] = (), least: int = 30) -> DataFrame:
    """The whole sequence: drop, times, site, segments, vocabularies, cost shares, numeric transforms, final checks."""
    df = df.drop(*drop)
    if time:
        df = time_features(df, time).drop(*datetime_columns(df))
    if site:
        df = site_bucket(df, site, least).drop(site)
    if segments:
        df = segment_features(df, segments).drop(*segments)
    for c in [c for c, t in df.dtypes if t == "string" and c != "site_bucket"]:
        df = vocabulary_column(df, c, least)
    if total and parts:
        df = cost_shares(df, total, parts)
    return final_checks(auto_transform(df, [c for c in numeric_columns(df) if c not in ("hour", "dow", "month", "is_weekend", "num_segments")]))


def stratify_key(df: DataFrame, columns: Sequence[str], name: str = "stratum") -> DataFrame:
    return df.withColumn(name, F.concat_ws("_", *[F.coalesce(_q(c).cast("string"), F.lit("")) for c in columns]))


def parse_generated_rows(df: DataFrame, column: str, names: Sequence[str], header: bool = True) -> DataFrame:
    """Rows of delimited text in generated answers: code fences and a header line go, fields are padded or trimmed to names."""
    text = F.regexp_replace(_q(column), r"```[a-z]*", "")
    lines = df.select(F.posexplode(F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != "")).alias("at", "line"))
    if header:
        lines = lines.where(~(F.lower(F.regexp_replace("line", r"\s", "")) == ",".join(names).lower()))
    fields = F.split("line", ",")
    return lines.select(*[F.trim(F.get(fields, F.lit(k))).alias(c) for k, c in enumerate(names)])


def render_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """text: '<column>: <value>, ...' of each row, for prompts."""
    columns = columns or [*numeric_columns(df), *string_columns(df)]
    return df.select(F.concat_ws(", ", *[F.concat(F.lit(f"{c}: "), F.coalesce(_q(c).cast("string"), F.lit("null"))) for c in columns]).alias("text"))
