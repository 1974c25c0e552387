"""Log files and journal exports: lines, records, rotation, filters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars

# Bounds of records and groups.
MAX_BODY, MAX_CURSOR, MAX_JOURNAL = 1 << 20, 4096, 1 << 20
MAX_LINE, MAX_LINES, MAX_GROUP = 256 << 10, 200, 256 << 10


def frame_lines(files: DataFrame, key: list[str], content: str = "content") -> DataFrame:
    """key, pos, start_offset, end_offset, line: the finished lines of each file, offsets in bytes with the newline in the range.

    What follows the last newline is pending and has no row.
    """
    rows = files.select(*key, F.posexplode(F.split(F.col(content), "\n")).alias("pos", "line"), F.size(F.split(F.col(content), "\n")).alias("_n"))
    upto = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end_offset", F.sum(F.octet_length("line") + 1).over(upto))
    rows = rows.withColumn("start_offset", F.col("end_offset") - F.octet_length("line") - 1).where(F.col("pos") < F.col("_n") - 1)
    return rows.select(*key, "pos", F.col("start_offset").cast("long").alias("start_offset"), F.col("end_offset").cast("long").alias("end_offset"), scalars.strip_eol(F.col("line")).alias("line"))


def reject_reason(max_line_bytes: int = MAX_LINE, empty: bool = True) -> Column:
    """too_long, empty or null: a line's bytes with its newline count; empty lines are dropped unless lines are assembled."""
    long = (F.col("end_offset") - F.col("start_offset")) > max_line_bytes
    return F.when(long, "too_long").when(F.lit(empty) & (F.col("line") == ""), "empty")


def assemble_multiline(lines: DataFrame, key: list[str], start_pattern: str, max_lines: int = MAX_LINES) -> DataFrame:
    """key, start_offset, end_offset, n_lines, body, open: lines in groups, each begun by a match of start_pattern or after max_lines.

    open marks a file's last group, which is complete only after its flush time. One shuffle, by file.
    """
    order = Window.partitionBy(*key).orderBy("pos")
    rows = lines.withColumn("_g", F.sum(F.col("line").rlike(start_pattern).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*key, "_g").orderBy("pos")
    rows = rows.withColumn("_s", F.expr("0")).withColumn("_r", F.row_number().over(inside)).withColumn("_s", F.floor((F.col("_r") - 1) / max_lines))
    groups = rows.groupBy(*key, "_g", "_s").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"), F.min("start_offset").alias("start_offset"), F.max("end_offset").alias("end_offset"), F.max("pos").alias("_last"))
    last = F.max("_last").over(Window.partitionBy(*key))
    return groups.select(*key, "start_offset", "end_offset", F.size("l").alias("n_lines"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("body"), (F.col("_last") == last).alias("open"))


#: Lines of a block: what one task folds at a time.
BLOCK_LINES = 4096


def _blocks(lines: DataFrame, key: list[str], ahead: int, size: int) -> DataFrame:
    """lines with _i (their place among the file's _total lines) and _block; the first ahead lines of a block are also the end (_i beyond it) of the block before.

    Places are two sums: rows of stretches of positions, of which a file has a row each, and inside a stretch.
    """
    rows = lines.withColumn("_stretch", F.expr(f"pos div {size}"))
    counts = rows.groupBy(*key, "_stretch").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*key).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_base", F.coalesce(F.sum("_n").over(upto), F.lit(0))).withColumn("_total", F.sum("_n").over(Window.partitionBy(*key))).drop("_n")
    # a null in a key matches itself
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in (*key, "_stretch")]
    rows = rows.alias("r").join(counts.alias("c"), same).select("r.*", "c._base", "c._total")
    place = F.col("_base") + F.row_number().over(Window.partitionBy(*key, "_stretch").orderBy("pos")) - 1
    rows = rows.withColumn("_i", place).withColumn("_own", F.expr(f"_i div {size}"))
    twice = (F.col("_own") > 0) & (F.col("_i") % size < ahead)
    return rows.withColumn("_block", F.explode(F.when(twice, F.array("_own", F.col("_own") - 1)).otherwise(F.array("_own")))).drop("_stretch", "_base", "_own")


def _next_groups(sizes: np.ndarray, starts: np.ndarray, max_lines: int, max_bytes: int) -> np.ndarray:
    """Where the group that begins at each line ends: by the next start, the cap of lines or the cap of bytes, whichever comes first."""
    n = len(sizes)
    place = np.arange(n)
    total = np.append(0, np.cumsum(sizes + 1))
    # a group of lines i to j has total[j + 1] - total[i] - 1 bytes; its first line is in whatever its size
    full = np.searchsorted(total, total[:-1] + max_bytes + 1, "right") - 1
    begins = np.append(np.flatnonzero(starts), n)
    after = begins[np.searchsorted(begins, place, "right")] if n else place
    return np.minimum(np.minimum(after, place + max_lines), np.maximum(full, place + 1))


def assemble_multiline_bytes(lines: DataFrame, key: list[str], start_pattern: str, max_lines: int = MAX_LINES, max_bytes: int = MAX_GROUP, block_lines: int = BLOCK_LINES) -> DataFrame:
    """As assemble_multiline, with a greedy cap of bytes too.

    The fold over a file is composed of folds over blocks of block_lines lines. A group has at most max_lines lines, so the first
    group that begins in a block begins at one of its first max_lines lines; for each of these a block's map says where the first group of the
    next block then begins. Maps are small, and going through those of a file in order gives each block its entry. Groups are then built block by block, each with the lines ahead that its last group may take.
    Lines are shuffled by (file, block), so a large file is many tasks; a file is one task only as a row of at most max_lines numbers a block.
    """
    kinds = {f.name: f.dataType.simpleString() for f in lines.schema.fields}
    keys = ", ".join(f"`{k}` {kinds[k]}" for k in key)
    size = max(block_lines, 2 * max_lines)
    rows = _blocks(lines.withColumn("_start", F.col("line").rlike(start_pattern)).withColumn("_size", F.octet_length("line")), key, max_lines, size)

    def folded(t: pa.Table) -> tuple[pa.Table, np.ndarray, int]:
        """A block's lines in order, where each group would end, and how many lines are its own."""
        t = t.sort_by("_i")
        own = int((t.column("_i").to_numpy() // size == t.column("_block")[0].as_py()).sum())
        return t, _next_groups(t.column("_size").to_numpy(), t.column("_start").to_numpy(), max_lines, max_bytes), own

    def mapped(t: pa.Table) -> pa.Table:
        t, after, own = folded(t)
        to = after.copy()
        for i in range(own - 1, -1, -1):  # from the end, so that each line's way out is known before those that lead to it
            if after[i] < own:
                to[i] = to[after[i]]
        head = [t.column(k)[:1] for k in (*key, "_block")]
        return pa.table([*head, pa.array([(to[: min(own, max_lines)] - own).tolist()], pa.list_(pa.int32()))], names=[*key, "_block", "_map"])

    narrow = rows.select(*key, "_block", "_i", "_size", "_start")
    maps = narrow.groupBy(*key, "_block").applyInArrow(mapped, f"{keys}, _block long, _map array<int>")

    def entered(t: pa.Table) -> pa.Table:
        t = t.sort_by("_block")
        at, out = 0, []
        for to in t.column("_map").to_pylist():
            out.append(at)
            at = to[at] if at < len(to) else 0
        return pa.table([*(t.column(k) for k in (*key, "_block")), pa.array(out, pa.int32())], names=[*key, "_block", "_entry"])

    entries = maps.groupBy(*key).applyInArrow(entered, f"{keys}, _block long, _entry int")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"e.{k}")) for k in (*key, "_block")]
    held = rows.select(*key, "_block", "_i", "_total", "_size", "_start", "start_offset", "end_offset", "line").alias("r").join(entries.alias("e"), same).select("r.*", "e._entry")

    def built(t: pa.Table) -> pa.Table:
        t, after, own = folded(t)
        place, total = t.column("_i").to_pylist(), t.column("_total")[0].as_py()
        first, ends = [], []
        at = t.column("_entry")[0].as_py()
        while at < own:
            first.append(at)
            at = int(after[at])
            ends.append(at)
        text, begin, end = t.column("line").to_pylist(), t.column("start_offset").to_pylist(), t.column("end_offset").to_pylist()
        head = [pa.array([t.column(k)[0].as_py()] * len(first), t.schema.field(k).type) for k in key]
        spans = list(zip(first, ends, strict=True))
        values = [[begin[a] for a, _ in spans], [end[b - 1] for _, b in spans], [b - a for a, b in spans], ["\n".join(text[a:b]) for a, b in spans], [place[b - 1] == total - 1 for _, b in spans]]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_()]
        return pa.table([*head, *(pa.array(v, k) for v, k in zip(values, types, strict=True))], names=[*key, "start_offset", "end_offset", "n_lines", "body", "open"])

    return held.groupBy(*key, "_block").applyInArrow(built, f"{keys}, start_offset long, end_offset long, n_lines int, body string, open boolean")


def file_generations(seen: DataFrame, key: list[str], at: str = "seen_at") -> DataFrame:
    """seen with generation and restart: a file shorter than what was committed, or reopened with another fingerprint, is a new generation.

    seen: key, at, size, fingerprint, committed, reopened.
    """
    order = Window.partitionBy(*key).orderBy(at)
    cut = F.col("size") < F.col("committed")
    changed = F.col("reopened") & (F.lag("fingerprint").over(order) != F.col("fingerprint"))
    rows = seen.withColumn("restart", F.coalesce(cut, F.lit(False))).withColumn("_new", (F.col("restart") | F.coalesce(changed, F.lit(False))).cast("long"))
    return rows.withColumn("generation", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def start_offsets(files: DataFrame, state: DataFrame, key: list[str], start_at: str = "beginning") -> DataFrame:
    """files with start: the stored offset of a known file (also if its fingerprint changed), else 0 or the size."""
    first = F.lit(0).cast("long") if start_at == "beginning" else F.col("size")
    return files.join(state.select(*key, "offset"), key, "left").withColumn("start", F.coalesce("offset", first)).drop("offset")


def active_files(files: DataFrame, source: str = "source_id", name: str = "relative_path", most: int = 32) -> DataFrame:
    return files.withColumn("active", F.row_number().over(Window.partitionBy(source).orderBy(name)) <= most)


def parse_journal(entries: DataFrame, value: str = "value", fallback_us: str = "fallback_us", source: str = "journald") -> DataFrame:
    """entries with ok, cursor, admission_id, body, observed_us, service, severity and attributes of each JSON entry.

    Only text values count; what is missing, too long or has NUL is left out. ok is false for entries that are no records.
    """
    v = F.try_parse_json(value)
    rows = entries.withColumn("_v", F.when(F.octet_length(value) <= MAX_JOURNAL, v))

    def text(name: str) -> Column:
        got = F.try_variant_get("_v", f"$.{name}", "variant")
        return F.when(F.schema_of_variant(got) == "STRING", F.try_variant_get("_v", f"$.{name}", "string")).otherwise("")

    def bounded(name: str, most: int) -> Column:
        t = text(name)
        return F.when((F.octet_length(t) <= most) & ~t.contains("\x00"), t).otherwise("")

    cursor, body, stamp = text("__CURSOR"), text("MESSAGE"), text("__REALTIME_TIMESTAMP")
    us = F.when(stamp.rlike(r"^[+-]?[0-9]+\z"), stamp.try_cast("long"))
    unit, identifier = bounded("_SYSTEMD_UNIT", 256), bounded("SYSLOG_IDENTIFIER", 256)
    named = [("log.syslog.identifier", identifier), ("log.syslog.priority", bounded("PRIORITY", 8)), ("process.executable.name", bounded("_COMM", 256)), ("process.pid", bounded("_PID", 32)), ("journald.transport", bounded("_TRANSPORT", 64)), ("systemd.unit", unit)]
    attributes = F.map_filter(F.create_map(*[x for k, c in named for x in (F.lit(k), c)]), lambda k, x: x != "")
    ok = F.col("_v").isNotNull() & (cursor != "") & (F.octet_length(cursor) <= MAX_CURSOR) & (body != "") & (F.octet_length(body) <= MAX_BODY)
    return rows.select(
        *entries.columns,
        F.coalesce(ok, F.lit(False)).alias("ok"),
        cursor.alias("cursor"),
        scalars.journal_admission_id(F.lit(source), cursor).alias("admission_id"),
        body.alias("body"),
        F.when(us > 0, us).otherwise(F.col(fallback_us)).alias("observed_us"),
        F.when(identifier != "", identifier).otherwise(F.regexp_replace(unit, r"\.service\z", "")).alias("service"),
        scalars.severity(text("PRIORITY")).alias("severity"),
        attributes.alias("attributes"),
    )


def filter_journal(parsed: DataFrame, units: list[str] | None = None, identifiers: list[str] | None = None, priority: str | int | None = None) -> DataFrame:
    """Entries of the units and identifiers, and of the priority or a more urgent one; an empty list takes all."""
    out = parsed
    if units:
        out = out.where(F.col("attributes")["systemd.unit"].isin(*units))
    if identifiers:
        out = out.where(F.col("attributes")["log.syslog.identifier"].isin(*identifiers))
    if priority is not None:
        n = scalars.PRIORITIES.index(priority) if priority in scalars.PRIORITIES else int(priority)
        out = out.where(F.col("attributes")["log.syslog.priority"].try_cast("int") <= n)
    return out


def resume_from(entries: DataFrame, state: DataFrame, host: str = "host", order: str = "position", start_at: str = "beginning") -> DataFrame:
    """Entries after the stored cursor of their host; without one, from the stored start (whole seconds), else all or, from the end, none.

    A stored cursor that none of the host's entries has (they were rotated away) counts as none.
    state: host, cursor, since_us. entries: host, order, cursor, observed_us.
    """
    s = state.select(host, F.col("cursor").alias("_cursor"), F.col("since_us").alias("_since"))
    at = entries.join(s, host).where("cursor = _cursor").groupBy(host).agg(F.max(order).alias("_at"))
    rows = entries.join(s, host, "left").join(at, host, "left")
    since = F.expr("(_since div 1000000) * 1000000")
    keep = F.when(F.col("_at").isNotNull(), F.col(order) > F.col("_at")).when(F.col("_since").isNotNull(), F.col("observed_us") >= since).otherwise(start_at == "beginning")
    return rows.where(keep).select(entries.columns)


def valid_record(body: str = "body") -> Column:
    return F.coalesce((F.col(body) != "") & (F.octet_length(body) <= MAX_BODY), F.lit(False))


#: Fixed value: largest payload.
MAX_PAYLOAD = 4 << 20


def payload_fault(payload: str = "payload", most: int = MAX_PAYLOAD) -> Column:
    """empty, too_large, invalid or null: what keeps a payload (text or bytes) out; the bound is on its own bytes, and too large ones aren't parsed."""
    size = F.octet_length(payload)
    text = F.when(size <= most, F.col(payload).cast("string"))
    return F.when(F.coalesce(size, F.lit(0)) == 0, "empty").when(size > most, "too_large").when(F.try_parse_json(text).isNull(), "invalid")


def reject_payloads(rows: DataFrame, payload: str = "payload", most: int = MAX_PAYLOAD) -> tuple[DataFrame, DataFrame]:
    """The rows whose payload may be admitted, and the others with their reason."""
    marked = rows.withColumn("reason", payload_fault(payload, most))
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def all_logs(files: DataFrame, journal: DataFrame) -> DataFrame:
    """File records and journal records as one set of columns."""
    return files.unionByName(journal, allowMissingColumns=True)
