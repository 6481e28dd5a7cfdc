"""Layers kept up to date batch by batch: a new batch rewrites what depends on it only.

Every layer is stored by date and landed batch. A record of a new batch displaces copies
(same id, same epoch text) from the batches before it, or loses to them; only the batches
that lose or win a row are written anew, together with their gold state. Gold is kept as
count, sum, least and greatest per label and batch and folded on reading, since neither a
mean nor an extreme can give back a row that another batch took over.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from perigee.operators import layers
from perigee.operators.params import utc
from perigee.schemas import BRONZE, SILVER
from perigee.sources import tables

KEY = ["norad_cat_id", "epoch_raw"]
_batch = T.StructField("batch", T.StringType())
STORED_BRONZE = T.StructType([*BRONZE.fields, _batch])
STORED_SILVER = T.StructType([*SILVER.fields, T.StructField("epoch_raw", T.StringType()), _batch])
# one line per run of the job and batch it wrote: what readers of the layers have to take up
CHANGE = T.StructType(
    [T.StructField("landed", T.StringType()), T.StructField("metric_date", T.DateType()), _batch, T.StructField("row_count", T.LongType())]
)


class LayerStore:
    """Bronze, silver, gold state and gold below one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.paths = {name: f"{root.rstrip('/')}/{name}" for name in ("bronze", "silver", "gold_state", "gold", "changes", "keys")}

    def land(self, records: DataFrame, ingested_at: datetime, batch: str | None = None, strict: bool = False) -> list[tuple]:
        """Add the ``record_text`` rows of a batch; returns the (date, batch) parts written.

        A batch is named by its ingest instant unless ``batch`` says otherwise. Landing a
        batch of the same name again replaces it: what it had displaced comes back from
        bronze. So a run that was interrupted is repeated.
        """
        at = utc(ingested_at)
        batch = batch or at.strftime("%Y%m%dT%H%M%S")
        bronze = layers.build_bronze(records, F.lit(at), strict=strict).withColumn("batch", F.lit(batch))
        before = self.bronze_rows().where(F.col("batch") == batch)
        repeated = not before.isEmpty()
        if repeated:
            # read off before the batch's bronze goes
            _keyed(before).select(*KEY).distinct().write.mode("overwrite").parquet(self.paths["keys"])
        self._replace("bronze", bronze, "ingestion_date", {(at.date(), batch)})
        new = self.bronze_rows().where(F.col("batch") == batch)
        keys = _keyed(new).select(*KEY)
        if repeated:
            keys = keys.unionByName(self.spark.read.schema(keys.schema).parquet(self.paths["keys"]))
        keys = keys.distinct()
        return self._renew(keys, new, batch, at, repeated)

    def _renew(self, keys: DataFrame, new: DataFrame, batch: str, at: datetime, repeated: bool) -> list[tuple]:
        """Write the silver rows of the keys anew, in the batches where they change."""
        silver = self.silver_rows()
        held = _semi(silver, keys)
        if repeated:
            found = _silver_of(_semi(_keyed(self.bronze_rows()), keys, "_id"))
        else:
            found = held.unionByName(_silver_of(new))
        survivors = _survivors(found)
        place = F.struct(F.col("ingestion_date").alias("date"), "batch")
        # rows held before that are not where they were, or not there at all
        was = held.select(*KEY, place.alias("part"))
        now = survivors.select(*[F.col(k).alias(f"now_{k}") for k in KEY], place.alias("now_part"))
        same = F.col("part") == F.col("now_part")
        for k in KEY:
            same = same & F.col(k).eqNullSafe(F.col(f"now_{k}"))
        moved = was.join(now, same, "left_anti").select("part")
        gained = survivors.select(place.alias("part")) if repeated else moved.limit(0)
        touched = {(r["part"]["date"], r["part"]["batch"]) for r in moved.unionByName(gained).distinct().collect()}
        touched.add((at.date(), batch))
        inside = F.lit(False)
        for date, name in sorted(touched):
            inside = inside | ((F.col("ingestion_date") == F.lit(date)) & (F.col("batch") == name))
        kept = _anti(silver.where(inside), keys)
        self._replace("silver", kept.unionByName(survivors.where(inside)), "ingestion_date", touched)
        state = layers.gold_state(self.silver_rows().where(inside))
        self._replace("gold_state", state, "metric_date", touched)
        dates = sorted({date for date, _ in touched})
        gold = layers.folded_gold(self.gold_state_rows().where(F.col("metric_date").isin(dates)))
        self._replace("gold", gold, "metric_date", {(date,) for date in dates})
        counts = self.silver_rows().where(inside).groupBy(F.col("ingestion_date").alias("metric_date"), "batch").agg(F.count("*").alias("row_count"))
        log = self.spark.createDataFrame([(d, b) for d, b in sorted(touched)], "metric_date date, batch string")
        log = log.join(counts, ["metric_date", "batch"], "left").select(F.lit(batch).alias("landed"), "metric_date", "batch", F.coalesce("row_count", F.lit(0)).alias("row_count"))
        tables.conform(log, CHANGE).coalesce(1).write.mode("append").parquet(self.paths["changes"])
        return sorted(touched)

    def _replace(self, layer: str, rows: DataFrame, date: str, parts: set[tuple]) -> None:
        """Write the parts given and no others; a part without rows is emptied by name."""
        by = [date, "batch"][: len(next(iter(parts)))]
        places = ["/".join([self.paths[layer], *(f"{name}={value}" for name, value in zip(by, part, strict=True))]) for part in sorted(parts)]
        before = [set(tables.names_in(self.spark, place)) for place in places]
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*by).parquet(self.paths[layer])
        nothing = self.spark.createDataFrame([], T.StructType([f for f in rows.schema.fields if f.name not in by]))
        for place, names in zip(places, before, strict=True):
            if names and set(tables.names_in(self.spark, place)) == names:
                nothing.write.mode("overwrite").parquet(place)

    def bronze_rows(self) -> DataFrame:
        return tables.read_or_empty(self.spark, self.paths["bronze"], STORED_BRONZE)

    def silver_rows(self) -> DataFrame:
        return tables.read_or_empty(self.spark, self.paths["silver"], STORED_SILVER)

    def gold_state_rows(self) -> DataFrame:
        return tables.read_or_empty(self.spark, self.paths["gold_state"], layers.GOLD_STATE)

    def silver(self) -> DataFrame:
        return self.silver_rows().select(*SILVER.fieldNames())

    def gold(self) -> DataFrame:
        """The stored gold of all dates."""
        return tables.read_or_empty(self.spark, self.paths["gold"], layers.GOLD)

    def changes(self) -> DataFrame:
        """Which parts each landing wrote, and how many silver rows they have since."""
        return tables.read_or_empty(self.spark, self.paths["changes"], CHANGE)


def _keyed(bronze: DataFrame) -> DataFrame:
    """Bronze rows with the typed id that silver deduplicates by, beside the text."""
    typed = layers.parsing.long_or_null(F.col("norad_cat_id"))
    return bronze.withColumns({"_id_text": F.col("norad_cat_id"), "_id": typed}).withColumn("norad_cat_id", typed)


def _semi(rows: DataFrame, keys: DataFrame, restored: str | None = None) -> DataFrame:
    keys = keys.select(*[F.col(k).alias(f"k_{k}") for k in KEY])
    on = F.col(KEY[0]).eqNullSafe(F.col(f"k_{KEY[0]}")) & F.col(KEY[1]).eqNullSafe(F.col(f"k_{KEY[1]}"))
    found = rows.join(keys, on, "left_semi")
    return found.withColumn("norad_cat_id", F.col("_id_text")).drop("_id_text", "_id") if restored else found


def _anti(rows: DataFrame, keys: DataFrame) -> DataFrame:
    keys = keys.select(*[F.col(k).alias(f"k_{k}") for k in KEY])
    on = F.col(KEY[0]).eqNullSafe(F.col(f"k_{KEY[0]}")) & F.col(KEY[1]).eqNullSafe(F.col(f"k_{KEY[1]}"))
    return rows.join(keys, on, "left_anti")


def _silver_of(bronze: DataFrame) -> DataFrame:
    return layers.build_silver(bronze, keep=["epoch_raw", "batch"]).select(*STORED_SILVER.fieldNames())


def _survivors(silver: DataFrame) -> DataFrame:
    """Of the silver rows of one key that the newest ingest has, as in ``build_silver``."""
    order = Window.partitionBy(*KEY).orderBy(F.col("ingested_at").desc(), F.col("raw_record_json").asc(), F.col("batch").asc())
    return silver.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")
