"""Layer files, managed tables and append-only history."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from perigee import schemas

LAYER_DIRECTORIES = {
    "bronze": "bronze_orbit_records",
    "silver": "silver_orbit_snapshots",
    "gold": "gold_orbit_freshness_metrics",
    "rejects": "rejected_orbit_records",
}
# stored by date, so that reads of some dates leave the others alone
PARTITIONED = {"bronze": "ingestion_date", "silver": "ingestion_date", "gold": "metric_date"}
SCHEMAS = {"bronze": schemas.BRONZE, "silver": schemas.SILVER, "gold": schemas.GOLD}


def layer_paths(root: str) -> dict[str, str]:
    return {layer: f"{root.rstrip('/')}/{name}" for layer, name in LAYER_DIRECTORIES.items()}


def write_layer(df: DataFrame, layer: str, root: str, mode: str = "overwrite") -> str:
    """Write one layer as Parquet and return its path.

    No global sort and no repartition before the write: the files keep the
    distribution the last shuffle produced, and readers order what they show.
    """
    path = layer_paths(root)[layer]
    writer = df.write.mode(mode)
    if layer in PARTITIONED:
        writer = writer.partitionBy(PARTITIONED[layer])
    writer.parquet(path)
    return path


def read_layer(spark: SparkSession, layer: str, root: str) -> DataFrame:
    path = layer_paths(root)[layer]
    if layer not in SCHEMAS:
        return spark.read.parquet(path)
    return spark.read.schema(SCHEMAS[layer]).parquet(path).select(*SCHEMAS[layer].fieldNames())


def save_managed(df: DataFrame, table: str, mode: str = "overwrite") -> DataFrame:
    """Write a managed table and hand back its scan."""
    df.write.mode(mode).saveAsTable(table)
    return df.sparkSession.table(table)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table with a known schema; no rows while nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def replace_run(rows: DataFrame, schema: T.StructType, path: str, run_id: int) -> None:
    """Store a run's rows, one directory per run so that reads of a run prune.

    Only the run's own directory is replaced, so repeating a run is safe. A write by
    partition touches no directory when there are no rows: then it is emptied by name.
    """
    rows = conform(rows, schema)
    if rows.isEmpty():
        rows.drop("run_id").write.mode("overwrite").parquet(f"{path}/run_id={run_id}")
        return
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def replace_part(rows: DataFrame, schema: T.StructType, path: str, key: str, value: int, by: str) -> None:
    """Store one numbered part of a table, a directory of its own below ``path``, split by
    the column ``by``: only the directories of values the rows hold are made."""
    rows = conform(rows, schema).repartition(by)
    rows.write.mode("overwrite").partitionBy(by).parquet(f"{path}/{key}={value}")


def read_parts(spark: SparkSession, schema: T.StructType, path: str, key: str, values: list[int]) -> DataFrame:
    """The rows of the numbered parts; parts without rows, or never written, have none.

    Listing prunes to the parts, and a filter on the column they are split by to its
    directories.
    """
    found = spark.createDataFrame([], schema)
    there = [f"{path}/{key}={value}" for value in values if has_files(spark, f"{path}/{key}={value}")]
    if not there:
        return found
    return spark.read.schema(schema).option("basePath", path).parquet(*there).select(*schema.fieldNames())


def scratch_folder(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share (spark.checkpoint.dir).

    Where that is unset, and the master is local, a temporary folder is set and used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="perigee-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/perigee-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def has_files(spark: SparkSession, path: str) -> bool:
    """Whether a directory holds anything but its marks of completion."""
    return any(not name.startswith(("_", ".")) for name in names_in(spark, path))


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names in a directory, none while it does not exist."""
    system, place = _file_system(spark, path)
    if not system.exists(place):
        return []
    return [status.getPath().getName() for status in system.listStatus(place)]


def claim(spark: SparkSession, path: str) -> bool:
    """Put an empty file where none is; only one of several callers gets True.

    Rests on the file system's create-if-absent, which Hadoop's client for local files
    does not keep apart from a test before; these are made by the operating system.
    """
    system, place = _file_system(spark, path)
    if system.getUri().getScheme() == "file":
        local = Path(place.toUri().getPath())
        local.parent.mkdir(parents=True, exist_ok=True)
        try:
            local.touch(exist_ok=False)
        except FileExistsError:
            return False
        return True
    try:
        return system.createNewFile(place)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" not in str(error.java_exception.getClass()):
            raise
        return False


def claim_number(spark: SparkSession, path: str) -> int:
    """A number that no other caller has: the next one above those claimed, or the first
    above that which nobody else takes meanwhile."""
    number = max([int(name) for name in names_in(spark, path) if name.isdigit()], default=0) + 1
    while not claim(spark, f"{path}/{number}"):
        number += 1
    return number


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to a schema's columns and types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
