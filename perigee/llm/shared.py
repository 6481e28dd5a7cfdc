"""Tables written in the folder that driver and executors share, and batch helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the session's checkpoint folder.

    The cluster names that folder in spark.checkpoint.dir. Only where the setting is
    absent (tests, a single machine) a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        base = context._jsc.sc().getCheckpointDir()
        base = base.get() if base.isDefined() else None
        if base is None:
            base = tempfile.mkdtemp(prefix="perigee-shared-")
            context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/perigee-{uuid.uuid4().hex}"


def stored(frame: DataFrame, path: str) -> DataFrame:
    """Write the rows as Parquet in a shared folder and read them back.

    Cuts the lineage: a lost executor costs the tasks it ran, not the stages before.
    """
    schema = frame.schema
    frame.write.mode("overwrite").parquet(path)
    return frame.sparkSession.read.schema(schema).parquet(path)


def rows_of(frame: DataFrame, **columns: str) -> DataFrame:
    """The named input columns alone, so that no other column of the table can clash."""
    return frame.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def smallest(rows: DataFrame, group: str, order: str, k: int, most_groups: int = 10_000) -> DataFrame:
    """The rows that hold the `k` smallest 64-bit orders of each group, and few more.

    Orders are counted by their first 16 bits; the bin in which the k-th falls is found
    over 256 coarse bins and the 256 fine ones of one of these, so no task sees more of a
    group than that. Beside k rows, those that share the last bin come out (about one in
    65,536 of a group where orders are hashes). Groups with fewer rows come out whole.
    Only one row a group, of groups with k rows or more, is held by the driver and sent to
    the tasks; more than `most_groups` of these are an error.
    """
    by_bin = Window.partitionBy(group).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def crossing(bins: DataFrame, wanted) -> DataFrame:
        upto = bins.withColumn("upto", F.sum("n").over(by_bin))
        return upto.where((F.col("upto") - F.col("n") < wanted) & (F.col("upto") >= wanted))

    fine = rows.groupBy(group, F.shiftright(order, 48).alias("bin")).agg(F.count("*").alias("n"))
    coarse = crossing(fine.groupBy(group, F.shiftright("bin", 8).alias("bin")).agg(F.sum("n").alias("n")), F.lit(k))
    coarse = coarse.select(group, F.col("bin").alias("coarse"), (F.lit(k) - F.col("upto") + F.col("n")).alias("left"))
    near = fine.withColumn("coarse", F.shiftright("bin", 8)).join(coarse, [group, "coarse"])
    last = crossing(near, F.col("left")).select(group, F.col("bin").alias("last_bin"))
    bounds = last.limit(most_groups + 1).collect()
    if len(bounds) > most_groups:
        raise ValueError(f"more than {most_groups} values in column {group}")
    bounds = F.broadcast(rows.sparkSession.createDataFrame(bounds, last.schema))
    kept = rows.join(bounds, group, "left").where(F.col("last_bin").isNull() | (F.shiftright(order, 48) <= F.col("last_bin")))
    return kept.drop("last_bin")


def sliced(batch: pa.RecordBatch, text_col: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, in slices of about `most_bytes` bytes of text."""
    sizes = pc.fill_null(pc.binary_length(column(batch, text_col)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // most_bytes
    starts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
    for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=False):
        yield batch.slice(a, b - a)


def map_batches(
    frame: DataFrame,
    schema: str,
    work: Callable[[pa.RecordBatch], dict[str, list | pa.Array]],
    text_col: str | None = None,
    most_bytes: int | None = None,
) -> DataFrame:
    """Apply `work` to each Arrow batch; it returns columns by name for `schema`. With
    `most_bytes` it gets slices of about that much text in `text_col`, one after the other."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            for part in [batch] if most_bytes is None else sliced(batch, text_col, most_bytes):
                columns = work(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        value.cast(field.type) if isinstance(value := columns[field.name], pa.Array) else pa.array(value, field.type)
                        for field in target
                    ],
                    schema=target,
                )

    return frame.mapInArrow(run, schema)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes | None]:
    """The UTF-8 bytes of a string column, one value at a time."""
    for value in column(batch, name):
        yield value.as_buffer().to_pybytes() if value.is_valid else None
