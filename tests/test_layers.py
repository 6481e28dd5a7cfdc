from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from perigee import schemas
from perigee.operators import layers, metrics
from perigee.plans import medallion
from perigee.sources import payloads, tables
from tests.samples import INGESTED, ISS, NO_EPOCH, OLD, record_rows


def bronze_of(spark, *records):
    return layers.build_bronze(record_rows(spark, *records), F.lit(INGESTED))


def silver_of(spark, *records):
    rows = layers.build_silver(bronze_of(spark, *records)).withColumn("epoch_text", F.col("epoch").cast("string"))
    return {r["norad_cat_id"]: r for r in rows.collect()}


def test_bronze_keeps_source_shape_and_adds_lineage(spark):
    bronze = bronze_of(spark, ISS, ISS, OLD, NO_EPOCH)
    assert [(f.name, f.dataType) for f in bronze.schema.fields] == [
        (f.name, f.dataType) for f in schemas.BRONZE.fields
    ]
    rows = bronze.collect()
    assert len(rows) == 4
    iss = next(r for r in rows if r["object_name"].startswith("ISS"))
    assert (iss["norad_cat_id"], iss["epoch_raw"], iss["mean_motion_raw"]) == (
        "25544", "2026-05-28T02:50:05.123456", "15.49123456",
    )
    assert json.loads(iss["raw_record_json"]) == ISS
    assert list(json.loads(iss["raw_record_json"])) == sorted(ISS)
    assert iss["source_name"] == "CelesTrak GP active"
    assert str(iss["ingestion_date"]) == "2026-05-28"
    missing = next(r for r in rows if r["norad_cat_id"] == "81234")
    assert missing["epoch_raw"] is None and missing["mean_motion_raw"] is None


def test_silver_types_labels_and_deduplicates(spark):
    rows = silver_of(spark, ISS, ISS, OLD, NO_EPOCH)
    assert len(rows) == 3
    assert rows[25544]["epoch_text"].startswith("2026-05-28 02:50:05")
    assert rows[25544]["epoch_age_hours"] == pytest.approx(1.998611, abs=1e-6)
    assert rows[40417]["epoch_age_hours"] == pytest.approx(97.5, abs=1e-6)
    labels = {k: (r["freshness_status"], r["quality_status"]) for k, r in rows.items()}
    assert labels == {
        25544: ("fresh", "valid"),
        40417: ("stale", "valid"),
        81234: ("unknown", "invalid_missing_epoch"),
    }


def test_silver_keeps_bad_values_as_null(spark):
    def one(**changes):
        return next(iter(silver_of(spark, {**ISS, **changes}).values()))

    assert one(NORAD_CAT_ID="abc")["quality_status"] == "invalid_missing_norad_cat_id"
    assert one(NORAD_CAT_ID="25544.0")["norad_cat_id"] == 25544
    assert one(NORAD_CAT_ID=" 25544 ")["norad_cat_id"] == 25544
    assert one(EPOCH="")["freshness_status"] == "unknown"
    assert one(EPOCH="not-a-date", NORAD_CAT_ID="abc")["quality_status"] == "invalid_missing_epoch"
    assert one(EPOCH="2026-05-28T02:50:05Z")["epoch_text"] == "2026-05-28 02:50:05"
    assert one(EPOCH="2026-05-28T02:50:05+02:00")["epoch_text"] == "2026-05-28 00:50:05"
    assert one(EPOCH="2026-05-28T06:50:00")["epoch_age_hours"] == -2.0
    assert one(EPOCH="2026-05-25T04:50:00")["freshness_status"] == "fresh"
    assert one(EPOCH="2026-05-25T04:49:59")["freshness_status"] == "stale"


def test_raw_epoch_text_is_the_duplicate_key_and_the_newest_ingest_survives(spark):
    same_instant = {**ISS, "EPOCH": ISS["EPOCH"] + "Z"}
    assert layers.build_silver(bronze_of(spark, ISS, same_instant)).count() == 2
    late = layers.build_bronze(
        record_rows(spark, {**ISS, "OBJECT_NAME": "later"}), F.lit(INGESTED) + F.expr("interval 1 hour")
    )
    kept = layers.build_silver(bronze_of(spark, ISS).unionByName(late)).collect()
    assert [r["object_name"] for r in kept] == ["later"]


def test_silver_ranks_before_the_shuffle(spark):
    """A group of copies reaches the shuffle as one row per map task."""
    plan = layers.build_silver(bronze_of(spark, ISS, OLD))._jdf.queryExecution().executedPlan().toString()
    partial = plan.index("WindowGroupLimit", plan.index("Exchange"))
    assert partial > 0 and plan.count("Exchange") == 1


def test_gold_counts(spark):
    gold = layers.build_gold(layers.build_silver(bronze_of(spark, ISS, ISS, OLD, NO_EPOCH)))
    counts = {r["freshness_status"]: r["satellite_count"] for r in gold.collect()}
    assert counts == {"fresh": 1, "stale": 1, "unknown": 1}
    kpis = medallion.gold_kpis(gold)
    pivot = kpis["freshness_pivot"].collect()[0]
    assert (pivot["fresh_satellites"], pivot["stale_satellites"], pivot["total_satellites"]) == (1, 1, 3)


def test_quality_kpi_is_mean_of_means_with_weighted_column(spark):
    gold = spark.createDataFrame(
        [("2026-05-28", "s", "fresh", "valid", 3, 10.0, 1.0, 20.0), ("2026-05-28", "s", "stale", "valid", 1, 90.0, 90.0, 90.0)],
        "metric_date string, source_name string, freshness_status string, quality_status string, "
        "satellite_count long, avg_epoch_age_hours double, min_epoch_age_hours double, max_epoch_age_hours double",
    )
    row = metrics.quality_by_date(gold).collect()[0]
    assert (row["avg_epoch_age_hours"], row["weighted_avg_epoch_age_hours"]) == (50.0, 30.0)


def test_contract_rejects_wrong_type_and_nulls(spark):
    gold = layers.build_gold(layers.build_silver(bronze_of(spark, ISS)))
    assert metrics.require_contract(gold) is gold
    with pytest.raises(ValueError, match="satellite_count"):
        metrics.require_contract(gold.withColumn("satellite_count", F.col("satellite_count").cast("int")))
    with pytest.raises(ValueError, match="source_name"):
        metrics.require_contract(gold.withColumn("source_name", F.lit(None).cast("string")))
    with pytest.raises(ValueError, match="metric_date"):
        metrics.require_contract(gold.drop("metric_date"))


def test_shape_check_splits_records(spark):
    rows = [("[" + json.dumps(ISS) + ', 5, "text", [1]]',), ('{"a": 1}',), ("garbage",), ("[]",), ("",)]
    records = payloads.explode_payloads(spark.createDataFrame(rows, "payload string"))
    checked = payloads.check_shape(records)
    assert payloads.accepted(checked).count() == 1
    reasons = sorted(r["reject_reason"] for r in payloads.rejected(checked).collect())
    assert reasons == ["item_not_an_object"] * 3 + ["payload_not_a_list"] * 3
    with pytest.raises(Exception, match="catalog payload: "):
        payloads.accepted(checked, strict=True).count()


def test_medallion_job_writes_three_layers(spark, tmp_path):
    landed = tmp_path / "landed.json"
    landed.write_text(json.dumps([ISS, ISS, OLD, NO_EPOCH], indent=2))
    paths = medallion.run_medallion(spark, str(landed), str(tmp_path / "out"), INGESTED)
    assert [spark.read.parquet(paths[k]).count() for k in ("bronze", "silver", "gold")] == [4, 3, 3]
    assert set(paths) == {"bronze", "silver", "gold"}
    landed.write_text(json.dumps([ISS, 5, OLD]))
    paths = medallion.run_medallion(spark, str(landed), str(tmp_path / "loose"), INGESTED, strict=False)
    assert [spark.read.parquet(paths[k]).count() for k in ("bronze", "rejects")] == [2, 1]
    assert spark.read.parquet(paths["rejects"]).first()["reject_reason"] == "item_not_an_object"
    day = tables.read_layer(spark, "silver", str(tmp_path / "loose")).where("ingestion_date = date'2026-05-28'")
    assert day.count() == 2 and "PartitionFilters: [isnotnull(ingestion_date" in day._jdf.queryExecution().executedPlan().toString()
    lines = tmp_path / "landed.jsonl"
    lines.write_text("\n".join(json.dumps(r) for r in (ISS, OLD)) + "\n")
    paths = medallion.run_medallion(spark, str(lines), str(tmp_path / "out2"), INGESTED, lines=True)
    assert spark.read.parquet(paths["bronze"]).count() == 2
    loaded = metrics.load_gold(spark.read.parquet(paths["gold"]), str(tmp_path / "olap"))
    assert loaded.count() == 2 and loaded.schema["loaded_at"].dataType.simpleString() == "timestamp_ntz"
    again = metrics.load_gold(spark.read.parquet(paths["gold"]), str(tmp_path / "olap"))
    assert again.count() == 2


def test_managed_table(spark):
    gold = layers.build_gold(layers.build_silver(bronze_of(spark, ISS)))
    assert tables.save_managed(gold, "gold_metrics_test").count() == 1
    spark.sql("DROP TABLE gold_metrics_test")
