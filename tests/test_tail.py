"""Log files that grow under a stream, and listings of a folder."""

import os
import tempfile

import pytest

from fleetgrain.operators import admission, evidence, logs
from fleetgrain.sources import files, tail


class Stream:
    def __init__(self, spark, **options):
        self.spark, self.root, self.options = spark, tempfile.mkdtemp(prefix="spark-"), options
        os.mkdir(f"{self.root}/logs")

    def append(self, name, data):
        with open(f"{self.root}/logs/{name}", "ab") as f:
            f.write(data)

    def run(self):
        lines = tail.stream_log_tail(self.spark, f"file://{self.root}/logs", **self.options)
        out = lines.writeStream.option("checkpointLocation", f"{self.root}/check").trigger(availableNow=True)
        out.format("parquet").option("path", f"{self.root}/out").start().awaitTermination()
        return sorted((r.relative_path, r.start_offset, r.end_offset, bytes(r.line)) for r in self.spark.read.schema(lines.schema).parquet(f"{self.root}/out").collect())


def test_appends_between_triggers(spark):
    s = Stream(spark, include=["*.log"], exclude=["no*"])
    s.append("a.log", b"one\r\ntw")
    s.append("no.log", b"never\n")
    s.append("other", b"never\n")
    first = [("a.log", 0, 5, b"one")]
    assert s.run() == first
    s.append("a.log", b"o\n\nthree")
    s.append("b.log", b"\xff\n")
    second = [*first, ("a.log", 5, 9, b"two"), ("a.log", 9, 10, b""), ("b.log", 0, 2, b"\xff")]
    assert s.run() == second
    os.rename(f"{s.root}/logs/a.log", f"{s.root}/logs/c.log")  # rotated: goes on under its new name
    s.append("c.log", b" and\n")
    s.append("a.log", b"new\n")
    third = [*second, ("c.log", 10, 20, b"three and"), ("a.log", 0, 4, b"new")]
    assert s.run() == sorted(third)
    with open(f"{s.root}/logs/b.log", "wb") as f:  # cut off
        f.write(b"\n")
    assert s.run() == sorted([*third, ("b.log", 0, 1, b"")])


def test_start_at_the_end(spark):
    s = Stream(spark, start_at="end")
    s.append("a.log", b"old\nhalf")
    assert s.run() == []
    s.append("a.log", b" line\nnew\n")
    s.append("late.log", b"whole\n")
    assert s.run() == [("a.log", 4, 14, b"half line"), ("a.log", 14, 18, b"new"), ("late.log", 0, 6, b"whole")]


@pytest.mark.parametrize("size", [1, 3, 7, 64])
def test_ranges_of_a_file_hold_each_line_once(tmp_path, monkeypatch, size):
    monkeypatch.setattr(tail, "RANGE_BYTES", size)
    monkeypatch.setattr(tail, "BACK_BYTES", 2)
    content = b"\n\nab\nabcdefgh\n" + b"x" * 50 + b"\n\nlast\nopen"
    (tmp_path / "f").write_bytes(content)
    reader = tail.TailReader({"path": f"file://{tmp_path}"})
    end = reader.latestOffset()
    assert list(end.values()) == [len(content) - 4]
    rows = [r for p in reader.partitions({}, end) for b in reader.read(p) for r in b.to_pylist()]
    want, at = [], 0
    for line in content.split(b"\n")[:-1]:
        want.append((at, at + len(line) + 1, line))
        at += len(line) + 1
    assert sorted((r["start_offset"], r["end_offset"], r["line"]) for r in rows) == want


def test_only_chosen_files_are_read(spark, tmp_path):
    for name in ("b.log", "a.log", "c.log", "d.txt"):
        (tmp_path / name).write_bytes(name.encode())
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "e.log").write_bytes(b"")
    found = files.read_log_files(spark, f"file://{tmp_path}", ["*.log"], ["c*"], 1)
    assert [(r.relative_path, r.size, bytes(r.content)) for r in found.collect()] == [("a.log", 5, b"a.log")]
    assert len(found.inputFiles()) == 1
    assert files.read_log_files(spark, f"file://{tmp_path}", ["none*"]).count() == 0


def test_payload_faults(spark):
    rows = [(1, '{"a":1}', None), (2, '{"a":', "invalid"), (3, "", "empty"), (4, None, "empty"), (5, '"' + "é" * 20 + '"', "too_large"), (6, "[1,2]", None), (7, '"' + "é" * 19 + '"', None)]
    df = spark.createDataFrame(rows, "id int, payload string, want string")
    kept, out = logs.reject_payloads(df, most=40)
    assert sorted(r.id for r in kept.collect()) == [1, 6, 7]
    assert all(r.reason == r.want for r in out.collect()) and out.count() == 4


def test_leaks_of_many_markers(spark):
    markers = [f"secret-{i:05d}-{i * 7919 % 10007}" for i in range(10_000)] + ["k", "éé", "abc", "", None, "secret-0000"]
    texts = [(1, "x secret-00042-2297 y"), (2, "secret-0004"), (3, "ab" + "c"), (4, None), (5, ""), (6, "kk éé"), (7, "secret-00042-229"), (None, "abc")]
    want = sorted(((i, m) for i, t in texts for m in markers if m and t and m in t), key=repr)
    df = spark.createDataFrame(texts, "id int, payload string")
    held = spark.createDataFrame([(m,) for m in markers], "marker string")
    for most in (1 << 20, 60_000):  # one scan, and several
        got = evidence.leaks_of(df, held, "id", marker_bytes=most)
        assert sorted(((r.id, r.marker) for r in got.collect()), key=repr) == want


def test_sketches_add_up_within_their_error(spark):
    from pyspark.sql import functions as F

    rows = spark.range(60_000).selectExpr("id % 3 as g", "id % 20 as day", "id % 17000 as v")
    sketches = evidence.distinct_sketches(rows, ["g"], F.col("day"), v=F.col("v"))
    assert sketches.count() == 60
    exact = {(r.g): r.n for r in rows.where("day >= 5 and day < 15").groupBy("g").agg(F.count_distinct("v").alias("n")).collect()}
    for r in evidence.merged_distinct(sketches, ["g"], ["v"], 5, 15).collect():
        assert abs(r.v - exact[r.g]) <= exact[r.g] * evidence.SKETCH_ERROR and r.n == 10_000


def test_admission_to_a_table_never_shuffles_its_history(spark, tmp_path):
    rows = lambda *ids: spark.createDataFrame([("s", i, k) for k, i in enumerate(ids)], "scope string, admission_id string, arrival long")
    files.write_spool_table(rows("a", "b"), "spool_of_test", f"file://{tmp_path}/spool", 8)
    files.write_spool_table(rows("c"), "spool_of_test", f"file://{tmp_path}/spool", 8)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    new = admission.admit_to_table(rows("c", "d", "d", "e"), "spool_of_test", 8)
    plan = new._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.admission_id, r.arrival) for r in new.collect())
    spark.conf.set(key, before)
    spark.sql("drop table spool_of_test")
    assert got == [("d", 1), ("e", 3)]
    assert plan.count("Exchange") == 1 and "SelectedBucketsCount: 8" in plan
