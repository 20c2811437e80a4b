"""Column roles, task types and column selection, all from one aggregate over the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .profile import column_facts, distinct_count, numeric_columns, string_columns

# Parts of names that mark a column of times.
TIME_WORDS = ("time", "date", "timestamp", "dt", "utc")


def _q(c: str):
    return F.col(f"`{c}`")


def roles_by_type(df: DataFrame, boolean_is_numeric: bool = False) -> dict[str, str]:
    """numeric or categorical by dtype; booleans are categorical unless asked otherwise."""
    numbers = set(numeric_columns(df, boolean_is_numeric))
    return {c: "numeric" if c in numbers else "categorical" for c in df.columns}


def role_facts(df: DataFrame) -> DataFrame:
    """column, n_rows, n_distinct (NULL counts), is_number, all_integer, number_share (rows that parse as a number)."""
    numbers = set(numeric_columns(df))
    plain = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType))]
    facts = {
        "n_rows": lambda c: F.count(F.lit(1)),
        "n_distinct": lambda c: distinct_count(c, nulls=True),
        "is_number": lambda c: F.lit(c in numbers),
        "all_integer": lambda c: F.coalesce(F.bool_and(_q(c) % 1 == 0), F.lit(False)) if c in numbers else F.lit(False),
        "number_share": lambda c: F.avg(_q(c).cast("string").try_cast("double").isNotNull().cast("double")),
    }
    return column_facts(df, facts, plain, {"n_rows": "long", "n_distinct": "long", "is_number": "boolean", "all_integer": "boolean"})


def infer_roles(df: DataFrame, few: int = 25, share: float = 0.7) -> DataFrame:
    """role_facts plus a role by each rule.

    role_cardinality: two values (NULL is one) are binary, up to `few` integers or any non-number categorical, else
    numeric. role_parse: numeric if more than `share` of the rows parse as a number."""
    binary = F.col("n_distinct") <= 2
    by_count = F.when(binary, "binary").when(~F.col("is_number"), "categorical").when(F.col("all_integer") & (F.col("n_distinct") <= few), "categorical").otherwise("numeric")
    return role_facts(df).withColumn("role_cardinality", by_count).withColumn("role_parse", F.when(F.col("number_share") > share, "numeric").otherwise("categorical"))


def task_type(df: DataFrame, target: str, few: int = 20, share: float = 0.05) -> DataFrame:
    """target, n_rows, n_classes, task: binclass for two values; multiclass for text, or for few values that are a small share of the rows; else regression."""
    numeric = target in numeric_columns(df)
    n, k = F.count(_q(target)), F.count_distinct(_q(target))
    row = df.agg(F.lit(target).alias("target"), n.alias("n_rows"), k.alias("n_classes"))
    small = (F.col("n_classes") <= few) & (F.col("n_classes") < share * F.col("n_rows"))
    return row.withColumn("task", F.when(F.col("n_classes") <= 2, "binclass").when(F.lit(not numeric) | small, "multiclass").otherwise("regression"))


def pick_target(df: DataFrame, name: str | None = None) -> str:
    """The named column; LAST_COLUMN: the rightmost text column with two or more values, else the last column."""
    if name and name != "LAST_COLUMN":
        if name not in df.columns:
            raise ValueError(f"no column {name!r}")
        return name
    if name == "LAST_COLUMN" and (texts := string_columns(df)):
        row = df.agg(*[F.approx_count_distinct(_q(c)).alias(c) for c in texts]).first()
        return next((c for c in reversed(texts) if row[c] >= 2), df.columns[-1])
    return df.columns[-1]


def id_like_columns(df: DataFrame, share: float = 0.95, many: int = 5000, allow: tuple[str, ...] = ()) -> DataFrame:
    """column, n_rows, n_distinct, id_like of string columns: nearly all values distinct, or very many."""
    texts = [c for c, t in df.dtypes if t == "string"]
    facts = column_facts(df, {"n_rows": lambda c: F.count(F.lit(1)), "n_distinct": distinct_count}, texts, {"n_rows": "long", "n_distinct": "long"})
    hit = ((F.col("n_distinct") >= share * F.col("n_rows")) | (F.col("n_distinct") >= many)) & ~F.col("column").isin(*allow or [""])
    return facts.withColumn("id_like", hit)


def constant_columns(df: DataFrame) -> DataFrame:
    """column, n_distinct (NULL counts), is_constant."""
    facts = column_facts(df, {"n_distinct": lambda c: distinct_count(c, nulls=True)}, None, {"n_distinct": "long"})
    return facts.withColumn("is_constant", F.col("n_distinct") <= 1)


def datetime_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if any(w in c.lower() for w in TIME_WORDS)]


def categorical_strings(df: DataFrame, share: float = 0.1) -> DataFrame:
    """column, n_distinct, as_category: string columns with fewer distinct values than a share of the rows."""
    texts = [c for c, t in df.dtypes if t == "string"]
    facts = column_facts(df, {"n_rows": lambda c: F.count(F.lit(1)), "n_distinct": distinct_count}, texts, {"n_rows": "long", "n_distinct": "long"})
    return facts.select("column", "n_distinct", (F.col("n_distinct") < share * F.col("n_rows")).alias("as_category"))


def unseen_categories(train: DataFrame, test: DataFrame, columns: list[str]) -> DataFrame:
    """column, value: categories of test that train doesn't have."""
    from .profile import values_long

    seen = values_long(train, columns).where("value is not null").distinct()
    return values_long(test, columns).where("value is not null").distinct().join(seen, ["column", "value"], "left_anti")


#: (type, exclusive lower bound, exclusive upper bound), smallest first.
_RANGES = (("tinyint", -128, 127), ("smallint", -32768, 32767), ("int", -2147483648, 2147483647))


def downcast_types(df: DataFrame) -> DataFrame:
    """column, old, new: smallest integer type whose bounds the values stay strictly inside, float for doubles, category for strings with fewer than half as many values as rows."""
    kept = [(c, t) for c, t in df.dtypes if t in ("bigint", "int", "smallint", "double", "string")]
    whole = ("bigint", "int", "smallint")
    types = dict(kept)
    facts = {
        "old": lambda c: F.lit(types[c]),
        "new": lambda c: F.lit("float")
        if types[c] == "double"
        else F.when(F.count_distinct(_q(c)) < 0.5 * F.count(F.lit(1)), "category").otherwise("string")
        if types[c] == "string"
        else F.coalesce(*[F.when((F.min(_q(c)) > lo) & (F.max(_q(c)) < hi), name) for name, lo, hi in _RANGES if whole], F.lit(types[c])),
    }
    return column_facts(df, facts, [c for c, _ in kept], {"old": "string", "new": "string"})


def apply_downcast(df: DataFrame) -> DataFrame:
    """df with the types of downcast_types (strings stay strings; Spark encodes repeated ones by itself)."""
    new = {r["column"]: r["new"] for r in downcast_types(df).collect() if r["new"] not in ("category", "string")}
    return df.withColumns({c: F.col(f"`{c}`").cast(t) for c, t in new.items()}) if new else df


def _role_rules() -> dict:
    """Rule name -> role, of role_facts: n_distinct counts NULL, n_values doesn't."""
    text, whole = F.col("is_text"), F.col("is_whole")
    return {
        # text is binary or categorical, whole numbers also where they have few values, all else is numeric
        "typed": F.when(text, F.when(F.col("n_distinct") == 2, "binary").otherwise("categorical"))
        .when(whole & (F.col("n_distinct") == 2), "binary")
        .when(whole & F.col("n_distinct").between(3, 25), "categorical")
        .otherwise("numeric"),
        # text, and whole numbers of 2 to 25 values
        "few_whole": F.when(text | (whole & F.col("n_values").between(2, 25)), "categorical").otherwise("numeric"),
        # text, and anything of 2 to 20 values
        "few_any": F.when(text | F.col("n_values").between(2, 20), "categorical").otherwise("numeric"),
    }


def roles_by_rules(df: DataFrame) -> DataFrame:
    """column, rule, role: each of the rules typed, few_whole and few_any on each column; a row each, so that one can be chosen."""
    kinds = {f.name: f.dataType for f in df.schema if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType))}
    facts = {
        "n_distinct": lambda c: distinct_count(c, nulls=True),
        "n_values": distinct_count,
        "is_text": lambda c: F.lit(isinstance(kinds[c], T.StringType)),
        "is_whole": lambda c: F.lit(isinstance(kinds[c], T.IntegralType)),
    }
    rows = column_facts(df, facts, list(kinds), {"n_distinct": "long", "n_values": "long", "is_text": "boolean", "is_whole": "boolean"})
    return rows.select("column", F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), v.alias("role")) for k, v in _role_rules().items()])).alias("r")).select("column", "r.*")


def tasks_by_rules(df: DataFrame, targets: list[str], few: int = 20, share: float = 0.05) -> DataFrame:
    """target, rule, task of several candidate targets, from one aggregate. NULL is no value.

    type: numbers (and booleans) are regression. few: numbers of more than `few` values are. share: floats, and whole
    numbers of more than max(few, share of the rows) values, are. What isn't is binclass up to two values, else multiclass;
    by type, exactly two."""
    kinds = {f.name: f.dataType for f in df.schema}
    facts = {
        "n_rows": lambda c: F.count(F.lit(1)),
        "n_values": distinct_count,
        "is_number": lambda c: F.lit(isinstance(kinds[c], (T.NumericType, T.BooleanType))),
        "is_whole": lambda c: F.lit(isinstance(kinds[c], T.IntegralType)),
        "is_float": lambda c: F.lit(isinstance(kinds[c], T.FractionalType)),
    }
    rows = column_facts(df, facts, targets, {"n_rows": "long", "n_values": "long"} | {k: "boolean" for k in ("is_number", "is_whole", "is_float")})
    k, classes = F.col("n_values"), F.when(F.col("n_values") <= 2, "binclass").otherwise("multiclass")
    rules = {
        "type": F.when(F.col("is_number"), "regression").when(k == 2, "binclass").otherwise("multiclass"),
        "few": F.when(F.col("is_number") & (k > few), "regression").otherwise(classes),
        "share": F.when(F.col("is_float") | (F.col("is_whole") & (k > F.greatest(F.lit(float(few)), share * F.col("n_rows")))), "regression").otherwise(classes),
    }
    return rows.select(F.col("column").alias("target"), F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), v.alias("task")) for n, v in rules.items()])).alias("r")).select("target", "r.*")
