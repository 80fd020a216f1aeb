"""Reading the tables and files that the engine works on, and cutting lineage through a written table."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers import this package where it lies at the same path (else ship it with --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the session's checkpoint folder. In local mode
    one of our own will do; a cluster without a shared folder is refused, as its executors couldn't read what others wrote."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not hasattr(spark, "_skein_scratch"):
        spark._skein_scratch = tempfile.mkdtemp(prefix="skein-")
    return spark._skein_scratch


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/skein-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def small(batches, rows: int = 256, size: int = 2**20):
    """The batches in slices of at most so many rows and bytes, one row at least, so that a worker's memory doesn't follow
    what Arrow hands over at once (10,000 rows)."""
    for whole in batches:
        todo = [whole]
        while todo:
            b = todo.pop()
            if b.num_rows > 1 and (b.num_rows > rows or b.nbytes > size):
                todo += [b.slice(b.num_rows // 2), b.slice(0, b.num_rows // 2)]
            else:
                yield b


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value and pos of each line of a text file."""
    return spark.read.text(path).withColumn("pos", F.monotonically_increasing_id())


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """url and pos of each line that is neither blank nor a comment."""
    return lines(spark, path).select(F.btrim("value").alias("url"), "pos").filter((F.col("url") != "") & ~F.col("url").startswith("#"))


def progress(spark: SparkSession, path: str) -> DataFrame:
    """The distinct URLs that were submitted already; an absent file has none."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.sql("SELECT '' AS url").limit(0)
    return spark.read.text(path).select(F.btrim("value").alias("url")).filter("url <> ''").distinct()


def domain_ranks(spark: SparkSession, path: str) -> DataFrame:
    """host and rank from a CSV of ranks; an unreadable path gives an empty table."""
    from pyspark.errors import AnalysisException

    from skein.operators.ranking import parse_domain_ranks

    try:
        return parse_domain_ranks(lines(spark, path))
    except AnalysisException:
        return spark.sql("SELECT '' AS host, 0 AS rank").limit(0)


def two_columns(spark: SparkSession, path: str) -> DataFrame:
    """url and n of a file with semicolons."""
    return spark.read.option("sep", ";").schema("url string, n int").csv(path)


def config(defaults: dict, path: str | None = None) -> dict:
    """defaults, with the keys of a JSON file in their place where the file is there."""
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            return defaults | json.load(f)
    return dict(defaults)


def number(value: str | None, default: int) -> int:
    """value as a number that isn't negative, default where it isn't one."""
    return int(value) if value is not None and value.isascii() and value.isdigit() else default


def env_file(text: str, given: dict[str, str]) -> dict[str, str]:
    """given, with the KEY=VALUE lines that it has no key for; quotes around a value go."""
    out = dict(given)
    for line in text.splitlines():
        key, eq, value = line.strip().partition("=")
        if eq and not key.startswith("#"):
            value = value.strip()
            if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"":
                value = value[1:-1]
            out.setdefault(key.strip(), value)
    return out


def requests(df: DataFrame, schema: str, defaults: dict, col: str = "value") -> DataFrame:
    """The fields of JSON requests, defaults where they are missing; malformed requests have _error."""
    body = df.withColumn("r", F.from_json(F.col(col), schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    names = [x.split()[0] for x in schema.split(",")]
    return body.select(*[F.coalesce(F.col(f"r.{n}"), F.lit(defaults[n])).alias(n) if defaults.get(n) is not None else F.col(f"r.{n}").alias(n) for n in names], F.col("r._corrupt").alias("_error"))
