"""Lines of files by byte ranges and groups of lines by blocks, against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from fleetgrain.operators import logs
from fleetgrain.sources import files


def framed(content: bytes):
    """(pos, start, end, line) of the finished lines."""
    out, at = [], 0
    for pos, line in enumerate(content.split(b"\n")[:-1]):
        out.append((pos, at, at + len(line) + 1, line[:-1] if line.endswith(b"\r") else line))
        at += len(line) + 1
    return out


@pytest.fixture
def small_ranges(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "700")
    yield
    spark.conf.set(key, before)


def test_a_large_file_is_many_tasks_with_the_same_lines(spark, tmp_path, small_ranges):
    rng = random.Random(3)
    line = lambda: bytes(rng.choice(b"abc \r\xc3\xa9\xff") for _ in range(rng.choice([0, 1, 5, 40, 40, 40, 2500])))
    held = {
        "long": b"\n".join(line() for _ in range(400)) + b"\n",
        "open": b"\n".join(line() for _ in range(50)) + b"\nstill open",
        "marked": b"\xef\xbb\xbffirst\r\n" + b"x" * 3000 + b"\nlast\n",
        "marked-open": b"\xef\xbb\xbfone\ntwo\nthree",
        "only-open": b"nothing finished",
        "blank": b"\n\n\r\n",
        "empty": b"",
    }
    for name, content in held.items():
        (tmp_path / name).write_bytes(content)
    found = files.read_lines(spark, f"file://{tmp_path}")
    got = {name: [] for name in held}
    for r in found.select("path", "pos", "start_offset", "end_offset", F.col("line").cast("binary").alias("line")).collect():
        got[r.path.rsplit("/", 1)[1]].append((r.pos, r.start_offset, r.end_offset, bytes(r.line)))
    # a pattern works on text: sequences that are none come back as the sign for them
    text = lambda rows: [(p, a, b, x.decode(errors="replace").encode()) for p, a, b, x in rows]
    for name, content in held.items():
        assert [r[:3] for r in sorted(got[name])] == [r[:3] for r in framed(content)], name
        if b"\xff" not in content and b"\xc3" not in content:
            assert text(sorted(got[name])) == text(framed(content)), name
    scan = spark.read.option("lineSep", "\n").text(f"file://{tmp_path}/long")
    assert scan.rdd.getNumPartitions() > 10


def test_offsets_inside_ranges_take_no_shuffle_of_lines(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"one\ntwo\n")
    plan = files.read_lines(spark, f"file://{tmp_path}")._jdf.queryExecution().executedPlan().toString()
    # the exchanges carry ranges; a join of few ranges is a broadcast at run time
    assert "MapInArrow" in plan and "Window [row_number" not in plan


def fold(lines, pattern, max_lines, max_bytes):
    start = re.compile(pattern)
    groups, size = [], 0
    for i, line in enumerate(lines):
        n = len(line.encode())
        if not groups or start.search(line) or len(groups[-1]) >= max_lines or size + 1 + n > max_bytes:
            groups.append([])
            size = -1
        groups[-1].append(i)
        size += 1 + n
    return groups


@pytest.mark.parametrize("max_lines, max_bytes, block", [(5, 60, 10), (3, 1 << 20, 4096), (7, 25, 1), (200, 400, 4096), (2, 1, 16)])
def test_blocks_fold_as_one_file_does(spark, max_lines, max_bytes, block):
    rng = random.Random(max_lines)
    made = {f: [rng.choice(["START ", "", "", ""]) + rng.choice(["a", "é", "long ", ""]) * rng.randint(0, 9) for _ in range(n)] for f, n in (("one", 1), ("few", 9), (None, 40), ("many", 1500), ("even", 2 * max_lines * 3))}
    rows = []
    for f, lines in made.items():
        at = 0
        for i, line in enumerate(lines):
            n = len(line.encode()) + 1
            rows.append((f, 3 * i + i % 2, at, at + n, line))  # with gaps, as rejected lines leave them
            at += n
    rng.shuffle(rows)
    got = logs.assemble_multiline_bytes(spark.createDataFrame(rows, "file string, pos int, start_offset long, end_offset long, line string"), ["file"], "^START", max_lines, max_bytes, block).collect()
    for f, lines in made.items():
        own = sorted((r.start_offset, r.end_offset, r.n_lines, r.body, r.open) for r in got if r.file == f)
        ends = [0]
        for line in lines:
            ends.append(ends[-1] + len(line.encode()) + 1)
        groups = fold(lines, "^START", max_lines, max_bytes)
        assert own == [(ends[g[0]], ends[g[-1] + 1], len(g), "\n".join(lines[i] for i in g), k == len(groups) - 1) for k, g in enumerate(groups)], f


def test_no_lines(spark):
    empty = spark.createDataFrame([], "file string, pos int, start_offset long, end_offset long, line string")
    assert logs.assemble_multiline_bytes(empty, ["file"], "^S").count() == 0
