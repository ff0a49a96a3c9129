"""Writing tables, reusing saved ones, and shared scratch space."""

from __future__ import annotations

import json
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessiongrid.schema import quoted


def _numbered(df: DataFrame, key: Sequence[str], weight: str | None = None) -> DataFrame:
    """Add ``_nth``: 1, 2 ... within each key, and ``_before``, the sum of ``weight`` (or 1) of the rows before.

    Rows that arrive clustered by the key are not moved again.
    """
    names = [quoted(name) for name in key]
    in_key = Window.partitionBy(*names).orderBy(names[0])
    nth = F.row_number().over(in_key)
    sums = F.sum(F.col(quoted(weight)) if weight else F.lit(1)).over(in_key.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumns({"_nth": nth, "_before": F.coalesce(sums, F.lit(0))})


def _observed(df: DataFrame, metrics: dict[str, Column]) -> tuple[DataFrame, Observation]:
    found = Observation()
    return df.observe(found, *[expression.alias(name) for name, expression in metrics.items()]), found


def write_table(
    df: DataFrame,
    path: str,
    format: str = "parquet",
    mode: str = "errorifexists",
    partition_by: str | None = None,
    sort_by: Sequence[str] = (),
    metrics: dict[str, Column] | None = None,
    count_repeats: bool = False,
) -> dict:
    """Write ``df``; an existing table is only replaced with ``mode="overwrite"``.

    With ``sort_by`` the files follow each other in that order: rows are cut into ranges, each
    sorted and written by its own task. Inside a partition folder the order is the same.

    ``metrics`` are aggregates that the writing tasks collect as rows pass them; they are
    returned, so no second pass over the table is needed. They count the tasks that wrote the
    table, each once, even if an executor is lost. With ``count_repeats`` they hold
    ``repeated_keys`` too, the ``sort_by`` keys of several rows: these are neighbours in the
    sorted range, so no further shuffle finds them.
    """
    metrics = dict(metrics or {})
    if sort_by:
        df = df.repartitionByRange(*[quoted(name) for name in sort_by])
        if count_repeats:
            df = _numbered(df, sort_by)
            metrics["repeated_keys"] = F.count_if(F.col("_nth") == 2)
    found = None
    if metrics:
        df, found = _observed(df, metrics)
    df = df.drop("_nth", "_before")
    if sort_by:
        df = df.sortWithinPartitions(*[quoted(name) for name in [*([partition_by] if partition_by else []), *sort_by]])
    writer = df.write.mode(mode).format(format)
    if format == "csv":
        writer = writer.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
            "ignoreTrailingWhiteSpace", False
        )
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.save(path)
    return found.get if found else {}


@contextmanager
def bucketed(
    df: DataFrame,
    path: str,
    by: str,
    sort_by: str,
    buckets: int | None = None,
    mode: str = "errorifexists",
    metrics: dict[str, Column] | None = None,
    weight: str | None = None,
) -> Iterator[tuple[DataFrame, dict]]:
    """``df`` written once, cut into ``buckets`` by ``by`` and sorted by ``sort_by`` inside, with its metrics.

    Windows and joins by ``by`` read it without a shuffle as long as the context is open. Spark
    keeps the cut in its catalog, so the files are a table there for that time; they stay
    under ``path``. ``metrics`` may use ``_nth``, the number of a row among those of its key
    (``by``, ``sort_by``), and ``_before``, the ``weight`` of the rows before it there.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if mode == "overwrite":
        fs, target = _file_system(spark, path)
        fs.delete(target, True)
    cut = _numbered(df.repartition(buckets, quoted(by)), [by, sort_by], weight)
    seen, found = _observed(cut, metrics) if metrics else (cut, None)
    name = f"bucketed_{uuid.uuid4().hex}"
    writer = seen.drop("_nth", "_before").write.format("parquet").bucketBy(buckets, by).sortBy(by, sort_by)
    try:
        writer.option("path", path).saveAsTable(name)
        yield spark.table(name), (found.get if found else {})
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is a file, or a directory whose writing job has committed."""
    fs, target = _file_system(spark, path)
    if not fs.exists(target):
        return False
    return fs.getFileStatus(target).isFile() or fs.exists(spark._jvm.org.apache.hadoop.fs.Path(target, "_SUCCESS"))


# --- tables saved as one set --------------------------------------------------------------

_MANIFESTS = "manifests"


def saved_set(spark: SparkSession, root: str) -> dict[str, str] | None:
    """Paths of the tables of the newest complete set under ``root``, by name; None without one."""
    fs, folder = _file_system(spark, f"{root}/{_MANIFESTS}")
    if not fs.exists(folder):
        return None
    names = [status.getPath().getName() for status in fs.listStatus(folder)]
    for name in sorted((n for n in names if n.endswith(".json")), reverse=True):
        tables = json.loads("\n".join(row["value"] for row in spark.read.text(f"{root}/{_MANIFESTS}/{name}").collect()))
        paths = {table: f"{root}/{place}" for table, place in tables.items()}
        if all(is_complete(spark, path) for path in paths.values()):
            return paths
    return None


def save_set(spark: SparkSession, root: str, write: Callable[[Callable[[str], str]], None]) -> dict[str, str]:
    """Save several tables under ``root`` as one version; returns their paths by name.

    ``write`` gets a function that names the path for a table, and writes the tables there. Each version has a folder of
    its own, and a manifest that lists its tables is put in place only after all of them are written. Until then
    ``saved_set`` gives the version before, so a reader never sees tables of two versions.
    Older versions stay for readers that still use them, until ``drop_old_sets``.
    """
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    tables: dict[str, str] = {}

    def place(name: str) -> str:
        tables[name] = f"versions/{version}/{name}"
        return f"{root}/{tables[name]}"

    write(place)
    incomplete = [name for name, at in tables.items() if not is_complete(spark, f"{root}/{at}")]
    if incomplete:
        raise ValueError(f"These tables of the set were not written: {incomplete}")
    fs, draft = _file_system(spark, f"{root}/{_MANIFESTS}/{version}.draft")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(tables).encode("utf-8")))
    out.close()
    # A file appears under its final name at once, whole or not at all.
    if not fs.rename(draft, spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{_MANIFESTS}/{version}.json")):
        raise OSError(f"The manifest of {root} could not be put in place.")
    return {name: f"{root}/{at}" for name, at in tables.items()}


def drop_old_sets(spark: SparkSession, root: str) -> int:
    """Delete every version but the newest complete one, and what interrupted writes left; returns their number.

    For the owner of ``root``, when no reader or writer is at work there.
    """
    current = saved_set(spark, root)
    fs, folder = _file_system(spark, f"{root}/versions")
    if current is None or not fs.exists(folder):
        return 0
    kept = next(iter(current.values())).removeprefix(f"{root}/versions/").split("/")[0]
    gone = 0
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name != kept:
            for suffix in ("json", "draft"):
                fs.delete(_file_system(spark, f"{root}/{_MANIFESTS}/{name}.{suffix}")[1], False)
            fs.delete(status.getPath(), True)
            gone += 1
    return gone


def cached(
    spark: SparkSession, root: str, loader: Callable[[], dict[str, DataFrame]], refresh: bool = False
) -> dict[str, DataFrame]:
    """The tables saved under ``root``; without them, or on refresh, load, save and read them back.

    Tables are reused only as the set they were saved in. If saving fails, the set before stays.
    """
    saved = None if refresh else saved_set(spark, root)
    if saved is None:

        def write(place: Callable[[str], str]) -> None:
            for name, table in loader().items():
                write_table(table, place(name))

        saved = save_set(spark, root, write)
    return {name: spark.read.parquet(path) for name, path in saved.items()}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors can reach.")
        root = tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to shared storage and go on from the written table.

    Used where several results need the same expensive input: it is computed once, later
    reads prune columns, and a lost executor does not bring the whole lineage back.
    """
    path = scratch_path(df.sparkSession, name)
    write_table(df, path)
    return df.sparkSession.read.parquet(path)


def fingerprint(df: DataFrame, digits: int = 12) -> DataFrame:
    """Row count and two order-free digests of the rows: equal tables give equal values.

    A row is hashed as the text of its columns by name: the length of each value and the value,
    or ``-`` for NULL, so (NULL, 1) differs from (1, NULL) and no separator can be faked. Doubles
    count to ``digits`` decimals. The hash is the first 60 bits of an MD5, so any engine that
    has it can check the digests. The sum also counts copies, which cancel out in the xor.
    """

    def text(field: T.StructField) -> Column:
        value = F.col(quoted(field.name))
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            value = (value * F.lit(10.0**digits)).try_cast("decimal(38,0)")
        value = value.cast("string")
        return F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    row = F.concat(*[text(field) for field in sorted(df.schema, key=lambda field: field.name)])
    hashed = df.select(F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("long").alias("h"))
    return hashed.agg(
        F.count("*").alias("rows"),
        F.bit_xor("h").alias("xor_hash"),
        F.sum(F.col("h").cast("decimal(38,0)")).alias("sum_hash"),
    )
