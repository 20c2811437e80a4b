"""Files in and out. Paths go to Spark's readers and Hadoop's file system, never to open(), so any store works."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = {".csv": "csv", ".parquet": "parquet", ".orc": "orc", ".json": "json"}


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def list_files(spark: SparkSession, folder: str, suffix: str | None = None, recursive: bool = False) -> list[tuple[str, int, int]]:
    """(path, bytes, modified at) sorted by path; nothing for a missing folder."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return []
    out, it = [], fs.listFiles(p, recursive)
    while it.hasNext():
        f = it.next()
        name = f.getPath().toString()
        if suffix is None or name.endswith(suffix):
            out.append((name, f.getLen(), f.getModificationTime()))
    return sorted(out)


def load(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A table by its suffix. CSV types are inferred unless a schema is given; an unknown suffix or a missing path is an error."""
    kind = next((k for s, k in FORMATS.items() if path.lower().rstrip("/").endswith(s)), None)
    if not exists(spark, path):
        raise FileNotFoundError(path)
    if kind is None:
        raise ValueError(f"unsupported format: {path}")
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        return reader.option("header", True).option("inferSchema", schema is None).option("emptyValue", "").option("nullValue", None).csv(path)
    return reader.format(kind).load(path)


def chunks(df: DataFrame, size: int, order: Sequence[str]) -> Iterator[DataFrame]:
    """The table in pieces of `size` rows in the given order, numbered once."""
    from ..functions.ordered import with_row_number
    from ..session import cut

    rows = cut(with_row_number(df, list(order), "_row"), "chunks")
    n = rows.count()
    for k in range(-(-n // size)):
        yield rows.where((F.col("_row") >= k * size) & (F.col("_row") < (k + 1) * size)).drop("_row")


def chunk_ids(df: DataFrame, size: int, order: Sequence[str], name: str = "chunk") -> DataFrame:
    from ..functions.ordered import with_row_number

    return with_row_number(df, list(order), "_row").withColumn(name, F.floor(F.col("_row") / size)).drop("_row")


def discover(spark: SparkSession, folder: str, suffix: str = ".csv", recursive: bool = False) -> list[tuple[str, str]]:
    """(name, path) of the data files of a folder, sorted; a name is the file's stem."""
    return [(p.rsplit("/", 1)[-1].removesuffix(suffix), p) for p, _, _ in list_files(spark, folder, suffix, recursive)]


def load_named(spark: SparkSession, folder: str, name: str | None = None, suffix: str = ".csv") -> DataFrame:
    """The named data file of a folder, or its first one."""
    found = [(n, p) for n, p in discover(spark, folder, suffix) if name in (None, n)]
    if not found:
        raise FileNotFoundError(f"{folder}/{name or '*'}{suffix}")
    return load(spark, found[0][1])


def union_folder(spark: SparkSession, folder: str, suffix: str = ".csv") -> DataFrame:
    """All data files of a folder as one table, columns matched by name, missing ones NULL."""
    tables = [load(spark, p) for _, p in discover(spark, folder, suffix)]
    if not tables:
        raise FileNotFoundError(folder)
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def read_marked_lines(spark: SparkSession, path: str, schema: T.StructType | str, skip: int = 1, strip: str = ".") -> DataFrame:
    """Delimited text whose first lines are no data and whose lines end in a mark."""
    from ..functions.ordered import with_row_number

    lines = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id())
    lines = with_row_number(lines, ["_at"], "_row").where(F.col("_row") >= skip)
    ddl = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    clean = F.regexp_replace(F.trim("value"), "\\" + strip + "+$", "")
    return lines.where(F.trim("value") != "").select(F.from_csv(clean, ddl, {"ignoreLeadingWhiteSpace": "true"}).alias("r")).select("r.*")


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def read_split(spark: SparkSession, path: str, value: str, split: str = "split") -> DataFrame:
    """One split; the others' files aren't read."""
    return spark.read.parquet(path).where(F.col(split) == value).drop(split)


def write_json(spark: SparkSession, path: str, data: Mapping) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(json.dumps(data, default=str).encode()))
    finally:
        out.close()


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def save_samples(samples: DataFrame, folder: str, name: str, kind: str = "parquet", metadata: Mapping | None = None) -> str:
    """<folder>/<name>.<kind> and a metadata file beside it."""
    if kind not in ("csv", "parquet"):
        raise ValueError(f"unsupported format: {kind}")
    path = f"{folder}/{name}.{kind}"
    writer = samples.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)
    facts = {"name": name, "format": kind, "columns": samples.columns, "types": dict(samples.dtypes)} | dict(metadata or {})
    write_json(samples.sparkSession, f"{folder}/{name}.metadata.json", facts)
    return path


def load_samples(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """What save_samples wrote, with its types; None if there is none."""
    for kind in ("parquet", "csv"):
        path = f"{folder}/{name}.{kind}"
        if exists(spark, path):
            meta = f"{folder}/{name}.metadata.json"
            types = read_json(spark, meta)["types"] if exists(spark, meta) else {}
            return load(spark, path, ", ".join(f"`{c}` {t}" for c, t in types.items()) if types and kind == "csv" else None)
    return None


def list_samples(spark: SparkSession, folder: str) -> list[str]:
    return sorted(p.rsplit("/", 1)[-1].removesuffix(".metadata.json") for p, _, _ in list_files(spark, folder, ".metadata.json"))


def keep_latest(spark: SparkSession, folder: str, n: int = 5, suffix: str = ".json") -> list[str]:
    """The n files changed last stay, the others are deleted; the deleted paths."""
    by_age = sorted(list_files(spark, folder, suffix), key=lambda f: (-f[2], f[0]))
    gone = [p for p, _, _ in by_age[n:]]
    for p in gone:
        fs, path = _fs(spark, p)
        fs.delete(path, True)
    return gone


def storage_report(spark: SparkSession, folders: Mapping[str, str]) -> list[dict]:
    return [{"name": k, "files": len(found), "bytes": sum(b for _, b, _ in found)} for k, v in folders.items() for found in [list_files(spark, v, None, True)]]
