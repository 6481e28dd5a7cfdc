"""Layers landed batch by batch against the same rows built at once."""

from __future__ import annotations

from datetime import timedelta

from perigee.operators import layers
from perigee.plans.layered import LayerStore
from tests.samples import INGESTED, ISS, NO_EPOCH, OLD, record_rows


def days(number):
    return INGESTED + timedelta(days=number)


def rows_of(frame):
    return sorted((tuple(r[c] for c in sorted(frame.columns)) for r in frame.collect()), key=repr)


def at_once(store):
    silver = layers.build_silver(store.bronze_rows())
    return rows_of(silver), rows_of(layers.build_gold(silver))


def files_of(tmp_path, layer):
    """Names and times of the data files of each date."""
    out = {}
    for path in (tmp_path / layer).rglob("*.parquet"):
        date = next(p for p in path.parts if "_date=" in p).split("=")[1]
        out.setdefault(date, set()).add((path.name, path.stat().st_mtime_ns))
    return out


def variants(start, count):
    return [{**ISS, "NORAD_CAT_ID": k} for k in range(start, start + count)]


def test_a_new_date_leaves_the_files_of_others_alone(spark, tmp_path):
    store = LayerStore(spark, str(tmp_path))
    store.land(record_rows(spark, *variants(0, 5), OLD), days(0))
    store.land(record_rows(spark, *variants(100, 5), NO_EPOCH), days(1))
    before = {layer: files_of(tmp_path, layer) for layer in ("bronze", "silver", "gold_state", "gold")}
    assert store.land(record_rows(spark, *variants(200, 3), {**OLD, "NORAD_CAT_ID": "x"}), days(2)) == [(days(2).date(), "20260530T045000")]
    for layer, files in before.items():
        after = files_of(tmp_path, layer)
        assert len(after) == 3 and {d: after[d] for d in files} == files
    assert (rows_of(store.silver()), rows_of(store.gold())) == at_once(store)


def test_copies_are_taken_back_from_the_dates_that_had_them(spark, tmp_path):
    store = LayerStore(spark, str(tmp_path))
    store.land(record_rows(spark, *variants(0, 4)), days(0))
    store.land(record_rows(spark, *variants(10, 4), NO_EPOCH), days(1))
    second = files_of(tmp_path, "silver")[str(days(1).date())]
    # copies of two records of the first date: that date is written anew, the second is not
    touched = store.land(record_rows(spark, *variants(2, 2), *variants(20, 1)), days(2))
    assert [d for d, _ in touched] == [days(0).date(), days(2).date()]
    assert files_of(tmp_path, "silver")[str(days(1).date())] == second
    assert (rows_of(store.silver()), rows_of(store.gold())) == at_once(store)
    # all that is left of the first date goes, and a late batch loses to what is newer
    store.land(record_rows(spark, *variants(0, 2)), days(3))
    store.land(record_rows(spark, *variants(10, 1), *variants(30, 1)), days(-1))
    assert (rows_of(store.silver()), rows_of(store.gold())) == at_once(store)
    assert days(0).date() not in {r["metric_date"] for r in store.gold().collect()}
    counts = {(r["landed"], r["batch"]): r["row_count"] for r in store.changes().collect()}
    assert counts["20260531T045000", "20260528T045000"] == 0 and counts["20260527T045000", "20260527T045000"] == 1


def test_landing_a_batch_again_replaces_it(spark, tmp_path):
    store = LayerStore(spark, str(tmp_path))
    store.land(record_rows(spark, *variants(0, 3), NO_EPOCH), days(0))
    store.land(record_rows(spark, *variants(1, 3), {**OLD, "NORAD_CAT_ID": None}), days(1))
    first = at_once(store)
    store.land(record_rows(spark, *variants(1, 3), {**OLD, "NORAD_CAT_ID": None}), days(1))
    assert (rows_of(store.silver()), rows_of(store.gold())) == first == at_once(store)
    # without its copies, those of the first batch are back
    store.land(record_rows(spark, *variants(3, 1)), days(1))
    assert (rows_of(store.silver()), rows_of(store.gold())) == at_once(store)
    assert store.silver().count() == 5
    store.land(record_rows(spark, ISS).where("false"), days(1))
    assert (rows_of(store.silver()), rows_of(store.gold())) == at_once(store)
    assert store.silver().count() == 4 and {r["metric_date"] for r in store.gold().collect()} == {days(0).date()}


def test_an_interrupted_landing_is_repeated(spark, tmp_path, monkeypatch):
    store = LayerStore(spark, str(tmp_path))
    store.land(record_rows(spark, *variants(0, 3)), days(0))
    kept = rows_of(store.silver()), rows_of(store.gold())
    renew = LayerStore._renew
    monkeypatch.setattr(LayerStore, "_renew", lambda *a: None)
    store.land(record_rows(spark, *variants(2, 3)), days(1))
    assert (rows_of(store.silver()), rows_of(store.gold())) == kept
    monkeypatch.setattr(LayerStore, "_renew", renew)
    store.land(record_rows(spark, *variants(2, 3)), days(1))
    assert (rows_of(store.silver()), rows_of(store.gold())) == at_once(store) and store.silver().count() == 5
