"""Catalog ingestion with history kept as append-only tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from perigee import fixed_values as fixed, schemas
from perigee.operators import catalog as cat, history
from perigee.operators.params import utc
from perigee.sources import arrays, payloads, tables


class CatalogHistory:
    """Runs, snapshots and satellites under one root folder of the cluster's storage.

    Snapshots are partitioned by run, so the latest catalog reads one directory. Every run
    adds its sightings to the satellite table, in the buckets of the ids it holds; they
    count once the run is logged. Several writers may ingest at the same time: each has
    claimed its run id, writes directories of its own, and sightings merge in any order.
    From time to time ``compact_satellites`` folds the sightings into a base; a reader
    merges the base with the runs that are not in it.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.runs_path = f"{root.rstrip('/')}/ingestion_runs"
        self.snapshots_path = f"{root.rstrip('/')}/orbit_snapshots"
        self.claims_path = f"{root.rstrip('/')}/run_claims"
        self.sightings_path = f"{root.rstrip('/')}/satellite_sightings"
        self.bases_path = f"{root.rstrip('/')}/satellite_bases"
        self.base_log_path = f"{root.rstrip('/')}/satellite_base_log"
        self.base_claims_path = f"{root.rstrip('/')}/satellite_base_claims"

    def ingest(self, records: DataFrame, ingested_at: datetime, run_id: int | None = None) -> DataFrame:
        """Normalize, store the snapshots, then log the run; returns the latest catalog.

        A record without a usable id fails the whole run, as does a misshaped one;
        the run is logged only after its snapshots are complete.
        """
        run_id = self.next_run_id() if run_id is None else run_id
        at = F.lit(utc(ingested_at))
        if payloads.POSITION not in records.columns:
            records = records.withColumn(payloads.POSITION, F.lit(None).cast("bigint"))
        rows = cat.good(cat.normalize(records, at, keep=[payloads.POSITION]), strict=True)
        stored = history.stored_row(rows).withColumn("run_id", F.lit(run_id).cast("bigint"))
        tables.replace_run(stored, schemas.SNAPSHOT, self.snapshots_path, run_id)
        written = self._stored().where(F.col("run_id") == run_id)
        self._store_sightings(written, run_id)
        tables.replace_run(history.success_run(run_id, at, written), schemas.RUN, self.runs_path, run_id)
        return self.latest()

    def ingest_file(self, path: str, ingested_at: datetime, run_id: int | None = None) -> DataFrame:
        return self.ingest(arrays.read_record_arrays(self.spark, path), ingested_at, run_id)

    def refresh(
        self,
        path: str,
        now: datetime,
        force: bool = False,
        ttl_hours: float = fixed.REUSE_WITHIN_HOURS,
    ) -> DataFrame:
        """The latest catalog, ingesting the landed file only when the last success is
        older than ``ttl_hours`` or ``force`` is set. A failed ingest is logged, then raised."""
        if force or self.ingest_due(now, ttl_hours).first()["ingest_due"]:
            run_id = self.next_run_id()
            try:
                return self.ingest_file(path, now, run_id)
            except Exception as error:
                self.log_failure(now, str(error).split("\n")[0], run_id=run_id)
                raise
        return self.latest()

    def next_run_id(self) -> int:
        """A run id of one's own, by a claim that only one writer can make."""
        return tables.claim_number(self.spark, self.claims_path)

    def _store_sightings(self, snapshots: DataFrame, run_id: int) -> None:
        rows = history.sightings(_with_source_name(snapshots), [F.col(c) for c in SIGHTING_ORDER])
        tables.replace_part(rows, schemas.SATELLITE, self.sightings_path, "run", run_id, "bucket")
        if run_id in self._base()[1]:
            # a base holds what this run was before: a new one without runs makes all be merged anew
            self._log_base(tables.claim_number(self.spark, self.base_claims_path), [])

    def log_failure(
        self, at: datetime, message: str, http_status: int | None = None, run_id: int | None = None
    ) -> None:
        run_id = self.next_run_id() if run_id is None else run_id
        row = history.failed_run(self.spark, run_id, utc(at), message, http_status)
        tables.replace_run(row, schemas.RUN, self.runs_path, run_id)

    def runs(self) -> DataFrame:
        return tables.read_or_empty(self.spark, self.runs_path, schemas.RUN)

    def _stored(self) -> DataFrame:
        return tables.read_or_empty(self.spark, self.snapshots_path, schemas.SNAPSHOT)

    def snapshots(self) -> DataFrame:
        """Snapshots of all successful runs; those of a run that was cut off don't show."""
        logged = history.successful(self.runs()).select("run_id")
        return history.restored_row(self._stored().join(logged, "run_id", "left_semi"))

    def latest(self) -> DataFrame:
        found = history.latest_catalog(history.restored_row(self._stored()), self.runs())
        return found.orderBy("object_name", "norad_cat_id", payloads.POSITION)

    def lookup(self, norad_cat_id: int, include_raw: bool = False) -> DataFrame:
        """The latest catalog's record of one id; of several, the last in the payload."""
        order = [payloads.POSITION, "object_name", "raw_record_json"]
        return cat.bounded(cat.lookup(self.latest(), norad_cat_id, order), include_raw)

    def search(self, text: str, limit: int | None = fixed.SEARCH_LIMIT, include_raw: bool = False) -> DataFrame:
        """Records of the latest catalog that contain the text, by name and id."""
        order = ["object_name", "norad_cat_id", payloads.POSITION]
        return cat.bounded(cat.search(self.latest(), text, order, limit), include_raw)

    def totals(self) -> DataFrame:
        return cat.totals(self.latest())

    def recent_runs(self, limit: int = fixed.RUN_LIST_DEFAULT) -> DataFrame:
        return history.recent_runs(self.runs(), limit)

    def ingest_due(self, now: datetime, ttl_hours: float) -> DataFrame:
        return history.ingest_due(self.runs(), F.lit(utc(now)), ttl_hours)

    def satellites(self, norad_cat_id: int | None = None) -> DataFrame:
        """First and last sighting and latest names of every satellite, or of one, of which
        only the bucket is read. Reads no snapshots."""
        base_id, included = self._base()
        logged = [r["run_id"] for r in history.successful(self.runs()).select("run_id").collect()]
        added = tables.read_parts(self.spark, schemas.SATELLITE, self.sightings_path, "run", sorted(set(logged) - included))
        base = tables.read_parts(self.spark, schemas.SATELLITE, self.bases_path, "base", [base_id] if included else [])
        rows = base.unionByName(added)
        if norad_cat_id is not None:
            wanted = F.lit(norad_cat_id).cast("bigint")
            rows = rows.where((F.col("bucket") == history.bucket_of(wanted)) & (F.col("norad_cat_id") == wanted))
        return history.merged_sightings(rows).drop("last_run_id", "bucket")

    def compact_satellites(self) -> int:
        """Fold the sightings of all logged runs into a new base; readers use it once it is
        logged. Returns the base's number."""
        _, included = self._base()
        logged = {r["run_id"] for r in history.successful(self.runs()).select("run_id").collect()}
        base_id = tables.claim_number(self.spark, self.base_claims_path)
        old, _ = self._base()
        base = tables.read_parts(self.spark, schemas.SATELLITE, self.bases_path, "base", [old] if included else [])
        added = tables.read_parts(self.spark, schemas.SATELLITE, self.sightings_path, "run", sorted(logged - included))
        merged = history.merged_sightings(base.unionByName(added))
        tables.replace_part(merged, schemas.SATELLITE, self.bases_path, "base", base_id, "bucket")
        self._log_base(base_id, sorted(logged | included))
        return base_id

    def _base(self) -> tuple[int, set[int]]:
        """The newest logged base and the runs it holds: numbers of runs, as many as were ingested."""
        row = tables.read_or_empty(self.spark, self.base_log_path, BASE_LOG).orderBy(F.col("base_id").desc()).first()
        return (row["base_id"], set(row["run_ids"])) if row else (0, set())

    def _log_base(self, base_id: int, run_ids: list[int]) -> None:
        row = self.spark.createDataFrame([(run_ids, base_id)], "run_ids array<bigint>, base_id bigint")
        row.coalesce(1).write.mode("append").parquet(self.base_log_path)


BASE_LOG = T.StructType([T.StructField("run_ids", T.ArrayType(T.LongType())), T.StructField("base_id", T.LongType())])
# of an id's records in a run the latest counts, then the later one in the payload
SIGHTING_ORDER = ("ingested_at", "run_id", payloads.POSITION, "raw_record_json")


def _with_source_name(snapshots: DataFrame) -> DataFrame:
    return history.restored_row(snapshots).withColumn("source_name", F.col("source.name"))
