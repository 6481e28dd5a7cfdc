from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from perigee import schemas
from perigee.operators import catalog, history
from perigee.plans import tracking
from perigee.plans.history import CatalogHistory
from perigee.sources import tables
from tests.samples import INGESTED, ISS, ISS_ELEMENTS, NO_EPOCH, OLD, record_rows

ORDER = ["position"]


def normalized(spark, *records):
    return catalog.normalize(record_rows(spark, *records), F.lit(INGESTED), keep=["position"])


def test_normalizer_rules(spark):
    row = normalized(spark, {**ISS, "OBJECT_NAME": None}).collect()[0]
    assert row["object_name"] == "UNKNOWN"
    assert row["epoch_age_hours"] == pytest.approx(1.998577, abs=1e-6)
    future = normalized(spark, {**ISS, "EPOCH": "2026-06-01T00:00:00"}).collect()[0]
    assert (future["epoch_age_hours"], future["freshness_status"]) == (0.0, "fresh")
    assert normalized(spark, {**ISS, "EPOCH": "2026"}).collect()[0]["epoch"] is None
    odd = normalized(spark, {**ISS, "MEAN_MOTION": "1.5d", "INCLINATION": "1e400", "ECCENTRICITY": "nan"}).collect()[0]
    assert odd["mean_motion"] is None and odd["inclination"] == float("inf")
    assert odd["eccentricity"] != odd["eccentricity"]


def test_ids_follow_integer_parsing(spark):
    ids = [25544, 25544.7, " 25544 ", "25544.0", "abc", None]
    rows = normalized(spark, *[{**ISS, "NORAD_CAT_ID": i} for i in ids]).orderBy("position").collect()
    assert [r["norad_cat_id"] for r in rows] == [25544, 25544, 25544, None, None, None]
    assert catalog.rejects(normalized(spark, {**ISS, "NORAD_CAT_ID": "abc"})).count() == 1
    with pytest.raises(Exception, match="not_an_integer"):
        catalog.good(normalized(spark, {**ISS, "NORAD_CAT_ID": "abc"}), strict=True).collect()


def test_lookup_takes_the_last_copy_and_hides_raw(spark):
    rows = catalog.good(normalized(spark, ISS, {**ISS, "OBJECT_NAME": "second"}, OLD))
    found = catalog.bounded(catalog.lookup(rows, 25544, ORDER)).collect()
    assert [r["object_name"] for r in found] == ["second"]
    assert found[0]["raw_record_available"] and "raw_record_json" not in found[0].asDict()
    assert "raw_record_json" in catalog.bounded(rows, include_raw=True).columns
    body = catalog.to_response_json(catalog.bounded(catalog.good(normalized(spark, NO_EPOCH)))).first()["body"]
    assert '"epoch"' not in body and '"raw_record_available":true' in body


def test_search_and_totals(spark):
    rows = catalog.good(normalized(spark, ISS, OLD, NO_EPOCH))
    assert {r["norad_cat_id"] for r in catalog.search(rows, " zarya ", ORDER).collect()} == {25544}
    assert {r["norad_cat_id"] for r in catalog.search(rows, "2016-019", ORDER).collect()} == {40417}
    assert catalog.search(rows, "  ", ORDER).count() == 3
    assert catalog.search(rows, "", ORDER, limit=2).count() == 2
    assert catalog.totals(rows).collect()[0]["total_records"] == 3


def test_history_round_trip(spark, tmp_path):
    store = CatalogHistory(spark, str(tmp_path))
    assert store.latest().count() == 0 and store.recent_runs().count() == 0
    store.ingest(record_rows(spark, ISS, OLD), INGESTED)
    later = INGESTED + timedelta(hours=3)
    latest = store.ingest(record_rows(spark, {**ISS, "OBJECT_NAME": "ISS renamed"}), later)
    assert [r["object_name"] for r in latest.collect()] == ["ISS renamed"]
    store.log_failure(later + timedelta(hours=1), "request failed", 403)
    # the failed run is newer, the catalog still comes from the last success
    assert [r["norad_cat_id"] for r in store.latest().collect()] == [25544]
    assert store.latest().select("source.name").first()["name"] == "CelesTrak GP active"
    runs = [(r["run_id"], r["status"], r["record_count"], r["http_status"]) for r in store.recent_runs().collect()]
    assert runs == [(3, "error", 0, 403), (2, "success", 1, None), (1, "success", 2, None)]
    seen = {r["norad_cat_id"]: r for r in store.satellites().collect()}
    assert seen[25544]["object_name"] == "ISS renamed"
    assert seen[25544]["last_seen_at"] - seen[25544]["first_seen_at"] == timedelta(hours=3)
    # repeating a run replaces its own snapshots only
    store.ingest(record_rows(spark, ISS), later, run_id=2)
    assert store.snapshots().count() == 3
    assert [r["run_id"] for r in store.recent_runs().collect()] == [3, 2, 1]
    # also when there is nothing left of it
    assert store.ingest(record_rows(spark, ISS).where("false"), later, run_id=2).count() == 0
    assert [(r["run_id"], r["record_count"]) for r in store.recent_runs().collect()] == [(3, 0), (2, 0), (1, 2)]
    assert store.snapshots().count() == 2


def test_snapshots_of_a_run_that_was_cut_off_do_not_show(spark, tmp_path):
    store = CatalogHistory(spark, str(tmp_path))
    store.ingest(record_rows(spark, ISS), INGESTED)
    rows = history.stored_row(catalog.good(normalized(spark, OLD))).withColumn("run_id", F.lit(2).cast("bigint"))
    rows = rows.withColumn("record_position", F.lit(0).cast("bigint"))
    tables.replace_run(rows, schemas.SNAPSHOT, store.snapshots_path, 2)
    assert [r["norad_cat_id"] for r in store.satellites().collect()] == [25544]
    assert store.snapshots().count() == 1


def test_the_later_record_of_a_payload_wins(spark, tmp_path):
    store = CatalogHistory(spark, str(tmp_path / "store"))
    landed = tmp_path / "landed.json"
    landed.write_text(json.dumps([{**ISS_ELEMENTS, "OBJECT_NAME": "zeta"}, OLD, {**ISS_ELEMENTS, "OBJECT_NAME": "alpha"}]))
    found = store.refresh(str(landed), INGESTED)
    assert [r["object_name"] for r in store.lookup(25544).collect()] == ["alpha"]
    assert "raw_record_json" not in store.lookup(25544).columns
    assert {r["norad_cat_id"]: r["object_name"] for r in store.satellites().collect()} == {25544: "alpha", 40417: "KESTREL 4"}
    assert [r["object_name"] for r in tracking.prepared(found).collect()] == ["alpha"]
    assert [r["object_name"] for r in store.search("ze").collect()] == ["zeta"]
    assert store.totals().first()["total_records"] == 3


def test_a_failed_refresh_is_logged(spark, tmp_path):
    store = CatalogHistory(spark, str(tmp_path / "store"))
    landed = tmp_path / "landed.json"
    landed.write_text(json.dumps([ISS]))
    store.refresh(str(landed), INGESTED)
    landed.write_text(json.dumps([ISS, {**OLD, "NORAD_CAT_ID": None}]))
    with pytest.raises(Exception, match="not_an_integer"):
        store.refresh(str(landed), INGESTED + timedelta(hours=3))
    assert [(r["run_id"], r["status"]) for r in store.recent_runs().collect()] == [(2, "error"), (1, "success")]
    assert [r["norad_cat_id"] for r in store.latest().collect()] == [25544]


def test_refresh_reuses_a_recent_catalog(spark, tmp_path):
    store = CatalogHistory(spark, str(tmp_path / "store"))
    landed = tmp_path / "landed.json"
    landed.write_text(json.dumps([ISS, OLD]))
    after = lambda hours: INGESTED + timedelta(hours=hours)
    assert store.refresh(str(landed), INGESTED).count() == 2
    landed.write_text(json.dumps([ISS]))
    assert store.refresh(str(landed), after(1)).count() == 2
    assert store.refresh(str(landed), after(1), force=True).count() == 1
    landed.write_text("[]")
    assert store.refresh(str(landed), after(4)).count() == 0
    assert [r["record_count"] for r in store.recent_runs().collect()] == [0, 1, 2]


def test_bad_record_fails_the_run_and_leaves_the_log_alone(spark, tmp_path):
    store = CatalogHistory(spark, str(tmp_path))
    store.ingest(record_rows(spark, ISS), INGESTED)
    with pytest.raises(Exception, match="not_an_integer"):
        store.ingest(record_rows(spark, ISS, {**OLD, "NORAD_CAT_ID": None}), INGESTED)
    assert [r["run_id"] for r in store.runs().collect()] == [1]


def test_reuse_window(spark, tmp_path):
    store = CatalogHistory(spark, str(tmp_path))
    store.ingest(record_rows(spark, ISS), INGESTED)
    due = lambda hours: store.ingest_due(INGESTED + timedelta(hours=hours), 2.0).collect()[0]["ingest_due"]
    assert [due(1.99), due(2.0), due(2.001)] == [False, False, True]
    empty = store.runs().where("false")
    assert history.ingest_due(empty, F.lit(INGESTED)).collect()[0]["ingest_due"] is True


def test_equal_completion_times_go_to_the_higher_run(spark):
    rows = [(1, "success"), (2, "success"), (3, "error")]
    runs = spark.createDataFrame(rows, "run_id long, status string").withColumn("completed_at", F.lit(INGESTED))
    assert [r["run_id"] for r in history.latest_successful_run(runs).collect()] == [2]
    with pytest.raises(ValueError):
        history.recent_runs(runs, 101)


def test_upsert_keeps_first_sighting(spark):
    batch = spark.createDataFrame(
        [(1, "new name", "A", "s"), (2, "fresh", "B", "s")],
        "norad_cat_id long, object_name string, object_id string, source_name string",
    ).withColumn("ingested_at", F.lit(INGESTED))
    old = spark.createDataFrame([(1, "old", "A", "s"), (3, "kept", "C", "s")], batch.drop("ingested_at").schema)
    old = old.withColumn("first_seen_at", F.lit(INGESTED - timedelta(days=9))).withColumn(
        "last_seen_at", F.lit(INGESTED - timedelta(days=1))
    )
    rows = {r["norad_cat_id"]: r for r in history.upsert_satellites(old, batch, [F.col("ingested_at")]).collect()}
    assert {k: r["object_name"] for k, r in rows.items()} == {1: "new name", 2: "fresh", 3: "kept"}
    assert rows[1]["last_seen_at"] - rows[1]["first_seen_at"] == timedelta(days=9)
    assert rows[2]["last_seen_at"] == rows[2]["first_seen_at"]


def plain(frame):
    return sorted(tuple(r[c] for c in sorted(frame.columns)) for r in frame.collect())


def derived(store):
    """The satellite table from all visible snapshots, as it was before it was stored."""
    seen = store.snapshots().withColumn("source_name", F.col("source.name"))
    return history.satellites_seen(seen, [F.col(c) for c in ("ingested_at", "run_id", "record_position", "raw_record_json")])


def buckets_of(path, part):
    return {p.name for p in (path / part).iterdir() if p.is_dir()}


def test_satellites_are_stored_by_bucket_and_merged_by_readers(spark, tmp_path):
    store = CatalogHistory(spark, str(tmp_path))
    assert store.satellites().count() == 0
    catalog_rows = [{**ISS, "NORAD_CAT_ID": k, "OBJECT_NAME": f"object {k}"} for k in range(40)]
    store.ingest(record_rows(spark, *catalog_rows), INGESTED)
    store.ingest(record_rows(spark, {**OLD, "NORAD_CAT_ID": 7}, {**OLD, "NORAD_CAT_ID": 99}), INGESTED + timedelta(hours=1))
    assert plain(store.satellites()) == plain(derived(store)) and store.satellites().count() == 41
    # the second run touched the buckets of its two ids only
    assert 1 <= len(buckets_of(tmp_path / "satellite_sightings", "run=2")) <= 2
    one = store.satellites(7)
    assert [(r["object_name"], r["last_seen_at"] - r["first_seen_at"]) for r in one.collect()] == [("KESTREL 4", timedelta(hours=1))]
    used = {str(p).split("satellite_sightings/")[1].split("/part")[0] for p in one.inputFiles()}
    assert all("bucket" in u for u in used)
    assert all("/satellite_sightings/" in p and "/orbit_snapshots/" not in p for p in store.satellites().inputFiles())


def test_compaction_changes_no_row_and_later_runs_merge_with_it(spark, tmp_path):
    store = CatalogHistory(spark, str(tmp_path))
    store.ingest(record_rows(spark, ISS, OLD), INGESTED)
    store.ingest(record_rows(spark, {**ISS, "OBJECT_NAME": "second"}), INGESTED + timedelta(hours=1))
    before = plain(store.satellites())
    store.compact_satellites()
    assert plain(store.satellites()) == before
    assert "run=" not in str(store.satellites().inputFiles())
    store.ingest(record_rows(spark, NO_EPOCH, {**ISS, "OBJECT_NAME": "third"}), INGESTED + timedelta(hours=2))
    assert plain(store.satellites()) == plain(derived(store)) and store.satellites().count() == 3
    store.compact_satellites()
    # a run that is repeated after a base took it in counts as it is now
    store.ingest(record_rows(spark, {**OLD, "OBJECT_NAME": "anew"}), INGESTED + timedelta(hours=1), run_id=2)
    assert plain(store.satellites()) == plain(derived(store))


def test_an_interrupted_update_shows_the_old_table(spark, tmp_path, monkeypatch):
    store = CatalogHistory(spark, str(tmp_path))
    store.ingest(record_rows(spark, ISS), INGESTED)
    before = plain(store.satellites())
    monkeypatch.setattr(history, "success_run", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.ingest(record_rows(spark, {**ISS, "OBJECT_NAME": "never logged"}, OLD), INGESTED + timedelta(hours=1))
    assert plain(store.satellites()) == before and store.snapshots().count() == 1
    monkeypatch.undo()
    # the same for a base that was written and not logged
    monkeypatch.setattr(store, "_log_base", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.compact_satellites()
    assert plain(store.satellites()) == before


def test_writers_at_the_same_time_get_ids_of_their_own(spark, tmp_path, monkeypatch):
    one, two = (CatalogHistory(spark, str(tmp_path)) for _ in "ab")
    assert [one.next_run_id(), two.next_run_id()] == [1, 2]
    # both see the same claims, so both reach for the same number
    monkeypatch.setattr(tables, "names_in", lambda *a: ["1", "2"])
    assert [one.next_run_id(), two.next_run_id()] == [3, 4]
    monkeypatch.undo()
    with ThreadPoolExecutor(4) as pool:
        ids = list(pool.map(lambda _: CatalogHistory(spark, str(tmp_path)).next_run_id(), range(12)))
    assert sorted(ids) == list(range(5, 17))


def test_two_ingests_at_once_are_both_kept(spark, tmp_path):
    stores = [CatalogHistory(spark, str(tmp_path)) for _ in "ab"]
    rows = [record_rows(spark, ISS, {**OLD, "OBJECT_NAME": "from one"}), record_rows(spark, NO_EPOCH, {**OLD, "OBJECT_NAME": "from two"})]
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda k: stores[k].ingest(rows[k], INGESTED + timedelta(minutes=k)), range(2)))
    assert sorted(r["run_id"] for r in stores[0].runs().collect()) == [1, 2]
    names = {r["norad_cat_id"]: r["object_name"] for r in stores[0].satellites().collect()}
    assert names == {25544: "ISS (ZARYA)", 81234: "UNDATED 7", 40417: "from two"}
    assert plain(stores[0].satellites()) == plain(derived(stores[1]))
