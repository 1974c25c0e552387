"""Growing log files as a stream: finished lines after stored offsets, as they are appended."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..functions import scalars

#: Fixed value: files of a root that are followed.
MAX_FILES = 256
#: Bytes that one task reads, and bytes that are looked back for the last newline.
RANGE_BYTES, BACK_BYTES = 8 << 20, 1 << 20
SCHEMA = "relative_path string, identity string, start_offset long, end_offset long, line binary"


@dataclass
class Range(InputPartition):
    """Bytes start to end of a file that is read to last. A line belongs to the range in which it begins; a later range may begin inside one."""

    path: str
    name: str
    identity: str
    start: int
    end: int
    last: int
    later: bool


def _identity(fs: pafs.FileSystem, path: str, name: str) -> str:
    """Device and inode where the file system has them, which a renamed file keeps; else its name."""
    if isinstance(fs, pafs.LocalFileSystem):
        held = os.stat(path)
        return f"{held.st_dev:x}:{held.st_ino:x}"
    return name


def listed(root: str, include: list[str], exclude: list[str], most: int = MAX_FILES) -> list[tuple[str, str, str, int]]:
    """name, path, identity and size of the direct children of root that match, the first most by name."""
    fs, base = pafs.FileSystem.from_uri(root)
    found = [f for f in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if f.type == pafs.FileType.File]
    match = lambda name, some: any(re.search(scalars.glob_regex(p).replace(r"\z", r"\Z"), name) for p in some)
    kept = sorted((f.base_name, f.path, f.size) for f in found if match(f.base_name, include) and not match(f.base_name, exclude))[:most]
    return [(name, path, _identity(fs, path, name), size) for name, path, size in kept]


def _finished(fs: pafs.FileSystem, path: str, start: int, size: int) -> int:
    """The end of the last finished line between start and size, start where there is none."""
    with fs.open_input_file(path) as f:
        end = size
        while end > start:
            begin = max(start, end - BACK_BYTES)
            f.seek(begin)
            at = f.read(end - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return start


class TailReader(DataSourceStreamReader):
    """An offset is an object: by the identity of each file of the listing, how far its finished lines are read. The checkpoint keeps it."""

    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.include = json.loads(options.get("include", '["*"]'))
        self.exclude = json.loads(options.get("exclude", "[]"))
        self.most = int(options.get("maxfiles", MAX_FILES))
        self.at_end = options.get("startat", "beginning") == "end"
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return self.latestOffset() if self.at_end else {}

    def _listed(self) -> list[tuple[str, str, str, int]]:
        return listed(self.root, self.include, self.exclude, self.most)

    def latestOffset(self) -> dict:
        fs, _ = pafs.FileSystem.from_uri(self.root)
        out = {}
        for _, path, identity, size in self._listed():
            known = self.seen.get(identity, 0)
            out[identity] = _finished(fs, path, known if known <= size else 0, size)
        self.seen = out
        return dict(out)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        """Ranges between the offsets. A file shorter than its offset was cut off and is read anew; one without an offset is new."""
        out = []
        for name, path, identity, size in self._listed():
            first, last = start.get(identity, 0), end.get(identity, 0)
            first = 0 if size < first else first
            out += [Range(path, name, identity, a, min(a + RANGE_BYTES, last), last, a > first) for a in range(first, last, RANGE_BYTES)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.root)
        with fs.open_input_file(partition.path) as f:
            at = partition.start - partition.later
            f.seek(at)
            data = f.read(partition.end - at)
            if partition.later:  # from the first line that begins here; the byte before tells whether that is at once
                cut = data.find(b"\n") + 1 or len(data)
                at, data = at + cut, data[cut:]
            more = [data]
            while data and not data.endswith(b"\n"):  # the last line's end lies in a later range
                data = f.read(BACK_BYTES)
                data = data[: data.find(b"\n") + 1 or len(data)]
                more.append(data)
        lines = b"".join(more).split(b"\n")[:-1]
        for k in range(0, len(lines), 4096):
            some = lines[k : k + 4096]
            ends = (np.cumsum([len(line) + 1 for line in some]) + at).tolist()
            starts = [at, *ends[:-1]]
            at = ends[-1]
            bare = [line[:-1] if line.endswith(b"\r") else line for line in some]
            columns = [pa.array([partition.name] * len(some)), pa.array([partition.identity] * len(some)), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(bare, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["relative_path", "identity", "start_offset", "end_offset", "line"])

    def commit(self, end: dict) -> None:
        pass


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))


def stream_log_tail(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, start_at: str = "beginning", most: int = MAX_FILES) -> DataFrame:
    """relative_path, identity, start_offset, end_offset, line of the finished lines of the files in root, now and as they are appended.

    root is a URI that the driver and all executors reach. start_at counts for the files that are there when the stream first starts: `beginning` reads them
    whole, `end` what comes after their last finished line. A file that comes later, by a new identity, is read from its beginning; a renamed one goes on; one that is cut off starts anew.
    """
    spark.dataSource.register(LogTail)
    options = {"include": json.dumps(include or ["*"]), "exclude": json.dumps(exclude or []), "startat": start_at, "maxfiles": str(most)}
    return spark.readStream.format("log_tail").options(**options).load(root)
