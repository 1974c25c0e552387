"""Properties that hold for any input: ranges tile, ids are stable, results don't depend on partitioning."""

import random

import pytest
from pyspark.sql import functions as F

from fleetgrain.operators import logs
from fleetgrain.plans import catalog, records

from .compare import rows_of


@pytest.mark.parametrize("name", ["w4_assemble_multiline", "w8_delivery_outcome", "w9_latest_version", "h1_admission_id", "j3_idempotent_admission"])
def test_results_do_not_depend_on_partitions(spark, small, name):
    key, got = "spark.sql.shuffle.partitions", []
    before = spark.conf.get(key)
    for n in ("1", "23"):
        spark.conf.set(key, n)
        df = catalog.QUERIES[name](spark, small)
        got.append(rows_of([r.asDict() for r in df.collect()], sorted(df.columns)))
    spark.conf.set(key, before)
    assert got[0] == got[1]


def test_line_ranges_tile_the_file(spark):
    rng = random.Random(4)
    rows = [(str(i), "".join(rng.choice(["a", "é", "\n", "\r\n", "日", " "]) for _ in range(rng.randint(0, 30)))) for i in range(200)]
    lines = logs.frame_lines(spark.createDataFrame(rows, "file string, content string"), ["file"]).collect()
    for name, content in rows:
        mine = sorted((r.start_offset, r.end_offset, r.line) for r in lines if r.file == name)
        raw, at = content.encode(), 0
        for start, end, line in mine:
            assert start == at and raw[start:end].endswith(b"\n")
            assert raw[start:end].decode().removesuffix("\n").removesuffix("\r") == line
            at = end
        assert b"\n" not in raw[at:]


def test_every_line_is_in_one_group(spark, small):
    lines = records._lines(spark, small)
    groups = logs.assemble_multiline(lines, ["file"], "^[A-F]", 5)
    want = lines.groupBy("file").agg(F.count("*").alias("n"), F.min("start_offset").alias("a"), F.max("end_offset").alias("b")).collect()
    got = groups.groupBy("file").agg(F.sum("n_lines").alias("n"), F.min("start_offset").alias("a"), F.max("end_offset").alias("b")).collect()
    assert sorted(map(tuple, want)) == sorted(map(tuple, got))
    assert groups.where("n_lines > 5").count() == 0
