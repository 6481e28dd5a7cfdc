"""Landed arrays cut by byte ranges against the same files taken whole."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from perigee.plans import medallion
from perigee.sources import arrays, payloads
from pyspark.sql import functions as F
from tests.samples import INGESTED, ISS, NO_EPOCH, OLD

SIZE = "spark.sql.files.maxPartitionBytes"
COST = "spark.sql.files.openCostInBytes"


@pytest.fixture
def ranges_of(spark):
    """Sets the length of byte ranges for a test."""

    def use(size):
        spark.conf.set(SIZE, str(size))
        spark.conf.set(COST, "0")

    yield use
    spark.conf.unset(SIZE), spark.conf.unset(COST)


def by_ranges(spark, path):
    rows = arrays.read_record_arrays(spark, str(path)).collect()
    return sorted(((r["record_position"], r["record_text"], r["reject_reason"]) for r in rows), key=str)


def whole(spark, path):
    rows = payloads.explode_payloads(payloads.read_payload_files(spark, str(path))).collect()
    return sorted(((r["record_position"], r["record_text"], r["reject_reason"]) for r in rows), key=str)


def value(draw, depth=0):
    kind = draw.randrange(9 if depth < 3 else 6)
    if kind > 5:
        inner = [value(draw, depth + 1) for _ in range(draw.randrange(4))]
        return inner if kind == 6 else {f"k{i}": v for i, v in enumerate(inner)}
    return [draw.randrange(1000), None, True, 'a "quoted" \\ [text], {with} marks', "}}}]][[{{\\\\", "é漢🙂\n\t" + "\\" * draw.randrange(4)][kind]


@pytest.mark.parametrize("size", [29, 301, 1 << 20])
def test_items_and_positions_equal_taking_the_file_whole(spark, tmp_path, ranges_of, size):
    draw = random.Random(size)
    for k, layout in enumerate([{}, {"indent": 2}, {"separators": (",", ":")}]):
        items = [{"id": i, "value": value(draw)} if draw.random() < 0.8 else value(draw) for i in range(60)]
        (tmp_path / f"{k}.json").write_text(" " * k + json.dumps(items, ensure_ascii=bool(k % 2), **layout) + "\n" * k)
    expected = whole(spark, tmp_path)
    ranges_of(size)
    assert by_ranges(spark, tmp_path) == expected
    assert len(expected) == 180 and not any(r[2] for r in expected)


def test_one_file_is_cut_by_many_tasks(spark, tmp_path, ranges_of):
    path = tmp_path / "one.json"
    path.write_text(json.dumps([{**ISS, "NORAD_CAT_ID": i} for i in range(4000)]))
    ranges_of(32_000)
    frame = arrays.read_record_arrays(spark, str(path))
    used = {r[0] for r in frame.select(F.spark_partition_id()).distinct().collect()}
    assert len(used) > 10
    rows = frame.select("record_position", F.get_json_object("record_text", "$.NORAD_CAT_ID").cast("int").alias("id")).collect()
    assert sorted((r[0], r[1]) for r in rows) == [(i, i) for i in range(4000)]


@pytest.mark.parametrize("size", [5, 1 << 20])
def test_payloads_that_are_no_arrays(spark, tmp_path, ranges_of, size):
    (tmp_path / "empty.json").write_text("")  # Spark passes over files of no bytes, taken whole too
    assert payloads.read_payload_files(spark, str(tmp_path)).count() == 0
    texts = ["[]", " [ \n ] ", "\n", "  ", "{}", '{"a": [1, 2]}', '[{"a": 1}', '[{"a": "]', "12", '"[1]"', "][", "[1]]", "[1] [2]", '[[{"a": 1}]']
    for k, text in enumerate(texts):
        (tmp_path / f"{k:02}.json").write_text(text)
    ranges_of(size)
    rows = arrays.read_record_arrays(spark, str(tmp_path)).collect()
    found = {int(r["payload_path"][-7:-5]): r for r in rows}
    assert sorted(found) == list(range(2, len(texts))) and len(rows) == len(texts) - 2
    assert {r["reject_reason"] for r in rows} == {payloads.NOT_A_LIST} and {r["record_text"] for r in rows} == {None}


def test_an_item_that_is_no_json_leaves_its_neighbours(spark, tmp_path, ranges_of):
    (tmp_path / "a.json").write_text('[{"a": 1}, {broken}, nothing, {"b": "x" "y"}, {"c": 3},]')
    ranges_of(9)
    assert by_ranges(spark, tmp_path) == [
        (0, '{"a":1}', None),
        (1, " {broken}", arrays.NOT_JSON),
        (2, " nothing", arrays.NOT_JSON),
        (3, ' {"b": "x" "y"}', arrays.NOT_JSON),
        (4, '{"c":3}', None),
        (5, "", arrays.NOT_JSON),
    ]


def test_structure_from_either_side_of_a_quote():
    data = np.frombuffer(rb'a\\" [ "}\"{" ]', np.uint8)
    within, depth = arrays.structure(data, True)
    assert [bool(x) for x in within] == [c in "ssss" for c in "sss...." + "sssss" + "..."] and depth.tolist() == [0] * 5 + [1] * 9 + [0]
    assert depth[-1] == 0


def test_layers_are_built_from_ranges(spark, tmp_path, ranges_of):
    landed = tmp_path / "landed.json"
    landed.write_text(json.dumps([{**ISS, "NORAD_CAT_ID": i} for i in range(50)] + [OLD, NO_EPOCH, 7]))
    ranges_of(500)
    paths = medallion.run_medallion(spark, str(landed), str(tmp_path / "lake"), INGESTED, strict=False)
    assert spark.read.parquet(paths["bronze"]).count() == 52
    assert [(r["record_position"], r["reject_reason"]) for r in spark.read.parquet(paths["rejects"]).collect()] == [(52, payloads.NOT_AN_OBJECT)]
    with pytest.raises(Exception, match="item_not_an_object"):
        medallion.run_medallion(spark, str(landed), str(tmp_path / "strict"), INGESTED)
