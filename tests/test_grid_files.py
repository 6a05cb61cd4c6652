"""Grid files read in byte ranges: equal to reading each whole, whatever the layout, and defects stay errors."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from gridpulse.schemas import GRID_FILE
from gridpulse.sources.features import feature_texts
from gridpulse.sources.grid import grid_from_features, read_grid


@pytest.fixture
def small_ranges(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "257")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


def collection(rng, n, first=0):
    odd = ['}', '{"', '"features":[{', "\\", '\\"', "é{", "]}", "", '{"features": [1]}']
    features = []
    for k in range(first, first + n):
        ring = [[rng.uniform(9, 10), rng.uniform(45, 46)] for _ in range(rng.choice([4, 5, 60]))]
        features.append({
            "type": "Feature", "properties": {rng.choice(["cellId", "cell_id"]): rng.choice([k, str(k)]), "name": rng.choice(odd), "features": [{"a": rng.choice(odd)}]},
            "geometry": {"type": "Polygon", "coordinates": [ring]}})
    return {"type": "FeatureCollection", "name": 'x"}', "crs": {"type": "name", "properties": {"features": [{"x": "}"}]}}, "features": features, "bbox": [1, [2, {"q": 3}]]}


def whole(spark, path):
    reader = spark.read.schema(GRID_FILE).options(multiLine=True, mode="FAILFAST")
    return grid_from_features(reader.json(path))


def write(folder, name, text):
    (folder / name).write_text(text, encoding="utf-8")


@pytest.mark.parametrize("indent, ascii_", [(None, True), (2, False), ("\t", True)])
def test_equals_reading_files_whole(spark, tmp_path, small_ranges, indent, ascii_):
    rng = random.Random(str(indent))
    for k in range(3):
        text = json.dumps(collection(rng, rng.choice([1, 7, 25]), 100 * k), indent=indent, ensure_ascii=ascii_)
        write(tmp_path, f"{k}.geojson", text + ("\n \n" if k else ""))
    assert feature_texts(spark, str(tmp_path)).rdd.getNumPartitions() > 20
    got, want = read_grid(spark, str(tmp_path)).collect(), whole(spark, str(tmp_path)).collect()
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) > 2


def test_a_file_is_many_tasks(spark, tmp_path, small_ranges):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    write(tmp_path, "one.geojson", json.dumps(collection(random.Random(1), 200)))
    texts = feature_texts(spark, str(tmp_path / "one.geojson"))
    used = texts.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(used) > 15 and max(r.n for r in used) < 40 and sum(r.n for r in used) == 200


@pytest.mark.parametrize("break_", [
    lambda t: t[:-1], lambda t: t[:len(t) // 2], lambda t: t + "}", lambda t: t.replace('"features"', '"f"'), lambda t: "[" + t + "]",
    lambda t: t.replace('"features": [{"type": "F', '"features": [1, {"type": "F'), lambda t: t.replace('"bbox"', '"bbox'),
    lambda t: '{"features": {"a": 1}}', lambda t: '{"features": []}', lambda t: t.replace('"cellId"', '"x"').replace('"cell_id"', '"x"'),
    lambda t: t.replace('"coordinates"', '"c"'), lambda t: t.replace("}], \"bbox\"", "},], \"bbox\""), lambda t: "",
    lambda t: t.replace('}}, {"type": "Feature"', '}} {"type": "Feature"', 1), lambda t: t.replace("[[[", "[[[x", 1),
])
def test_defects_are_errors(spark, tmp_path, small_ranges, break_):
    text = json.dumps(collection(random.Random(2), 8))
    broken = break_(text)
    assert broken != text
    write(tmp_path, "bad.geojson", broken)
    with pytest.raises(Exception):
        read_grid(spark, str(tmp_path)).collect()


def test_compressed_files_and_repeated_ids(spark, tmp_path):
    import gzip

    text = json.dumps(collection(random.Random(3), 5))
    (tmp_path / "a.json.gz").write_bytes(gzip.compress(text.encode()))
    assert read_grid(spark, str(tmp_path / "a.json.gz")).count() == 5
    write(tmp_path, "b.geojson", text)
    write(tmp_path, "c.geojson", text)
    with pytest.raises(ValueError, match="repeat"):
        read_grid(spark, f"{tmp_path}/*.geojson")
