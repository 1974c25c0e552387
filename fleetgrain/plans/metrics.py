"""Queries of the metric operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import counters, points, reshape
from ..sources import otlp, tables

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def flat(attributes: str = "attributes"):
    """Attributes as k=v;k=v by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(attributes)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("attributes")


_RATED = f"""with {tables.COUNTERS},
prev as (select *, lag(cpu) over w as b, observed_us - lag(observed_us) over w as gap from counters window w as (partition by host order by observed_us, event_id)),
d as (select *, list_sum(cpu) - list_sum(b) as total, cpu[4] - b[4] + cpu[5] - b[5] as idle, len(list_filter(range(1, 9), lambda i: cpu[i] < b[i])) as fell from prev),
rated as (select *, case when gap > 0 and gap <= 120000000 and fell = 0 and total > 0 then (total - idle) / total * 100 end as used_pct from d)"""


@query(_RATED + " select host, observed_us, event_id, round(used_pct, 6) as used_pct from rated")
def w1_cpu_used_pct(spark: SparkSession, d: str) -> DataFrame:
    return counters.cpu_used_pct(tables.counter_samples(spark, d)).select("host", "observed_us", "event_id", F.round("used_pct", 6).alias("used_pct"))


@query(f"""with {tables.COUNTERS}, s as (select host, observed_us, event_id, start_us, unnest(range(1, 9)) as i, unnest(cpu) as value from counters),
r as (select *, observed_us - lag(observed_us) over w as gap, value - lag(value) over w as grown, lag(start_us) over w as was from s window w as (partition by host, i order by observed_us, event_id))
select host, observed_us, event_id, ['user','nice','system','idle','wait','interrupt','softirq','steal'][i] as state,
  round(case when gap > 0 and gap <= 120000000 and grown >= 0 and was = start_us then grown / (gap / 1e6::double) end, 6) as rate from r""")
def w2_counter_rate(spark: SparkSession, d: str) -> DataFrame:
    p = counters.cpu_time_points(tables.counter_samples(spark, d)).withColumn("state", F.col("attributes")["state"])
    return counters.counter_rate(p, ["host", "state"]).select("host", "observed_us", "event_id", "state", F.round("rate", 6).alias("rate"))


@query(f"""with {tables.COUNTERS} select host, observed_us, event_id, unnest(range(1, 9))::int as ordinal, 'system.cpu.time' as name, unnest(cpu) as value,
  'state=' || unnest(['user','nice','system','idle','wait','interrupt','softirq','steal']) as attributes from counters""")
def x1_cpu_time_points(spark: SparkSession, d: str) -> DataFrame:
    return counters.cpu_time_points(tables.counter_samples(spark, d)).select("host", "observed_us", "event_id", "ordinal", "name", "value", flat())


@query(_RATED + """ select host, observed_us, event_id, 'host.cpu.used_pct' as name, '%' as unit, round(used_pct, 6) as value, '' as attributes from rated where used_pct is not null
union all select host, observed_us, event_id, 'system.cpu.utilization', '1', round(used_pct / 100, 6), 'state=used' from rated where used_pct is not null""")
def x9_cpu_gauges(spark: SparkSession, d: str) -> DataFrame:
    p = counters.cpu_gauges(counters.cpu_used_pct(tables.counter_samples(spark, d)))
    return p.select("host", "observed_us", "event_id", "name", "unit", F.round("value", 6).alias("value"), flat())


def _exploded(spark: SparkSession, d: str, column) -> DataFrame:
    s = tables.snapshots(spark, d)
    return s.select("host", "observed_us", F.explode(column).alias("p")).select("host", "observed_us", "p.name", "p.unit", "p.kind", F.round("p.value", 6).alias("value"), flat("p.attributes"))


_MEMORY = """select host, observed_us, 'host.memory.used_pct' as name, '%' as unit, 'gauge' as kind, round((total - available)::double / total * 100, 6) as value, '' as attributes from mem
union all select host, observed_us, 'system.memory.usage', 'By', 'gauge', (total - available)::double, 'state=used' from mem
union all select host, observed_us, 'system.memory.usage', 'By', 'gauge', available::double, 'state=available' from mem
union all select host, observed_us, 'system.memory.utilization', '1', 'gauge', round((total - available)::double / total, 6), 'state=used' from mem"""
_LOAD = " union all ".join(f"select host, observed_us, 'system.cpu.load_average.{n}m' as name, '1' as unit, 'gauge' as kind, l{n} as value, '' as attributes from snaps where l1 is not null" for n in (1, 5, 15))


def _disks(most: int) -> str:
    parts = []
    for way, b, c, ms in (("read", "p", "p", "s"), ("write", "s", "s", "p")):
        for name, unit, value in (("io", "By", f"({b} * 512)::double"), ("operations", "{operations}", f"{c}::double"), ("operation_time", "s", f"round({ms} / 1000.0::double, 6)")):
            parts.append(f"select host, observed_us, 'system.disk.{name}' as name, '{unit}' as unit, 'sum' as kind, {value} as value, 'device=' || dev || ';direction={way}' as attributes from dk")
    parts.append("select host, observed_us, 'system.disk.pending_operations' as name, '{operations}' as unit, 'gauge' as kind, c::double as value, 'device=' || dev as attributes from dk")
    return f"dk as (select * from (select *, name as dev, row_number() over (partition by observed_us order by name) as n from disks) where n <= {most})", " union all ".join(parts)


def _nets(most: int) -> str:
    parts = []
    for way, field in (("receive", ("p * 100", "p", "c", "0")), ("transmit", ("s * 100", "s", "0", "c"))):
        for (name, unit), value in zip((("io", "By"), ("packets", "{packets}"), ("errors", "{errors}"), ("dropped", "{packets}")), field, strict=True):
            parts.append(f"select host, observed_us, 'system.network.{name}' as name, '{unit}' as unit, 'sum' as kind, ({value})::double as value, 'device=' || dev || ';direction={way}' as attributes from nt")
    return f"nt as (select * from (select *, name as dev, row_number() over (partition by observed_us order by name) as n from nets) where n <= {most})", " union all ".join(parts)


_MOUNTS = """lm as (select *, row_number() over (partition by observed_us order by mountpoint) as n from (select * from mounts where fstype in ('ext4', 'xfs', 'tmpfs', 'overlay')
  qualify row_number() over (partition by observed_us, mountpoint order by device) = 1))"""


def _mount_points(most: int) -> str:
    return " union all ".join(f"select host, observed_us, 'system.filesystem.usage' as name, 'By' as unit, 'gauge' as kind, {f}::double as value, 'device=' || device || ';mountpoint=' || mountpoint || ';state={s}' || ';type=' || fstype as attributes from lm where ok and n <= {most}" for f, s in (("used", "used"), ("free", "available")))


_MEM = "mem as (select * from snaps where total > 0 and available <= total)"


@query(f"with {tables.SNAPSHOTS}, {_MEM} {_MEMORY}")
def x2_memory_points(spark: SparkSession, d: str) -> DataFrame:
    return _exploded(spark, d, reshape.memory_points())


@query(f"with {tables.SNAPSHOTS} {_LOAD}")
def x3_load_points(spark: SparkSession, d: str) -> DataFrame:
    return _exploded(spark, d, reshape.load_points())


@query("with {}, {} {}".format(tables.SNAPSHOTS, *_disks(3)))
def x4_disk_points(spark: SparkSession, d: str) -> DataFrame:
    """With at most three devices a snapshot, so that the cap cuts (T1)."""
    return _exploded(spark, d, reshape.disk_points("disks", 3))


@query("with {}, {} {}".format(tables.SNAPSHOTS, *_nets(2)))
def x5_network_points(spark: SparkSession, d: str) -> DataFrame:
    """With at most two interfaces a snapshot, so that the cap cuts (T2)."""
    return _exploded(spark, d, reshape.network_points("nets", 2))


@query(f"with {tables.SNAPSHOTS}, {_MOUNTS} {_mount_points(2)}")
def x6_filesystem_points(spark: SparkSession, d: str) -> DataFrame:
    """Local file systems (P2), the first of each mountpoint (W10), at most two a snapshot (T3)."""
    return _exploded(spark, d, reshape.filesystem_points(reshape.local_mounts(), 2))


_COUNTS = """has as (select s.*, coalesce(dc, 0) as dc, coalesce(nc, 0) as nc, coalesce(mc, 0) as mc, coalesce(bad, 0) as bad, dc is null as nolines from snaps s
  left join (select observed_us, count(*) as dc from disks group by 1) using (observed_us) left join (select observed_us, count(*) as nc from nets group by 1) using (observed_us)
  left join (select observed_us, count(*) as mc, sum(case when not ok and n <= 2 then 1 else 0 end) as bad from lm group by 1) using (observed_us))"""
_ISSUES = " union all ".join(
    f"select host, observed_us, '{k}' as capability from has where {c}"
    for k, c in (("cpu", "cpu is null"), ("counter_origin", "cpu is not null and start_us is null"), ("memory", "total is null or not (total > 0 and available <= total)"), ("load", "l1 is null"), ("disk", "nolines"), ("disk_cardinality", "dc > 3"), ("network", "nolines"), ("network_cardinality", "nc > 2"), ("filesystem", "nolines or bad > 0"), ("filesystem_cardinality", "mc > 2"))
)


@query(f"with {tables.SNAPSHOTS}, {_MOUNTS}, {_COUNTS} {_ISSUES}")
def x7_issue_points(spark: SparkSession, d: str) -> DataFrame:
    s = tables.snapshots(spark, d)
    return s.select("host", "observed_us", F.explode(reshape.issues(3, 2, 2)).alias("i")).select("host", "observed_us", F.col("i.capability").alias("capability"))


#: The CPU points of snapshots, as counters.with_cpu_used_pct and reshape.cpu_points make them.
_CPU = """cp as (select *, list_sum(cpu) - list_sum(b) as total_d, cpu[4] - b[4] + cpu[5] - b[5] as idle_d from
  (select host, observed_us, cpu, lag(cpu) over w as b, observed_us - lag(observed_us) over w as gap from snaps where cpu is not null window w as (partition by host order by observed_us))),
cu as (select host, observed_us, cpu, case when gap > 0 and gap <= 120000000 and len(list_filter(range(1, 9), lambda i: cpu[i] < b[i])) = 0 and total_d > 0 then (total_d - idle_d) / total_d * 100 end as used from cp)"""
_CPU_POINTS = " union all ".join([
    *[f"select host, observed_us, 'system.cpu.time' as name, 's' as unit, 'sum' as kind, cpu[{i}] as value, 'state={state}' as attributes from cu" for i, state in enumerate(counters.CPU_STATES, 1)],
    "select host, observed_us, 'host.cpu.used_pct' as name, '%' as unit, 'gauge' as kind, round(used, 6) as value, '' as attributes from cu where used is not null",
    "select host, observed_us, 'system.cpu.utilization' as name, '1' as unit, 'gauge' as kind, round(used / 100, 6) as value, 'state=used' as attributes from cu where used is not null",
])


def _placed(*families: tuple[str, str]) -> str:
    """All points with their place: the family, the device or mountpoint in it, the point of it. families: (SQL, key) pairs."""
    return " union all ".join(f"select *, {n} as family, {key} as owner, {k} as nth from ({part})" for n, (sql, key) in enumerate(families) for k, part in enumerate(sql.split(" union all ")))


_DEVICE, _MOUNTED = "regexp_extract(attributes, 'device=([^;]*)', 1)", "regexp_extract(attributes, 'mountpoint=([^;]*)', 1)"
_EVERY = _placed((_CPU_POINTS, "''"), (_MEMORY.replace("\nunion all ", " union all "), "''"), (_LOAD, "''"), (_disks(3)[1], _DEVICE), (_nets(2)[1], _DEVICE), (_mount_points(2), _MOUNTED))
_CAP = 30
#: with ... sample as (points of whole snapshots under the caps, then issue points): see t4_cap_sample.
SAMPLE = f"""with {tables.SNAPSHOTS}, {_MEM}, {_CPU}, {_disks(3)[0]}, {_nets(2)[0]}, {_MOUNTS}, {_COUNTS}, every as ({_EVERY}),
kept as (select e.*, row_number() over (partition by e.observed_us order by family, owner, nth) as n from every e join snaps s using (observed_us) where e.kind <> 'sum' or (s.start_us is not null and s.cpu is not null)),
full_ones as (select host, observed_us, 'sample_cardinality' as capability from kept group by all having count(*) >= {_CAP}),
issue as ({_ISSUES} union all select * from full_ones),
parts as (select host, observed_us, name, unit, kind, value, attributes, n from kept where n <= {_CAP}
  union all select host, observed_us, 'host.agent.collection.issue', '1', 'gauge', 1.0::double, 'collector=' || capability || ';reason=unavailable_or_denied',
    1000 + list_position(['cpu', 'counter_origin', 'memory', 'load', 'disk', 'disk_cardinality', 'network', 'network_cardinality', 'filesystem', 'filesystem_cardinality', 'sample_cardinality'], capability) from issue)"""
PLACED = "select host, observed_us, (row_number() over (partition by observed_us order by n))::int as ordinal, name, unit, kind, value, attributes from parts"


def rated(spark: SparkSession, d: str) -> DataFrame:
    """The readings with used_pct: hosts are shuffled before the devices come to them."""
    return counters.with_cpu_used_pct(tables.readings(spark, d), tie="observed_us")


def sampled(used: DataFrame, telemetry: str | None = None) -> DataFrame:
    """Points of snapshots with used_pct, under caps that cut: 30 points, three devices, two interfaces, two mounts."""
    p = reshape.snapshot_points(used, _CAP, 3, 2, 2, telemetry)
    return p.select("host", "observed_us", "ordinal", "name", "unit", "kind", F.round("value", 6).alias("value"), flat())


@query(f"{SAMPLE} {PLACED}")
def t4_cap_sample(spark: SparkSession, d: str) -> DataFrame:
    """Points of whole snapshots with sums without origin dropped (P3), a cap of 30 points (T4), and issues after it (X7)."""
    return sampled(tables.devices(tables.with_lines(rated(spark, d), spark, d)))


@query(f"with {tables.POINTS} select host, ordinal, name, value from points where not isnan(value) and value >= 0 and (name like 'system.%' or name like 'host.%')")
def p1_valid_points(spark: SparkSession, d: str) -> DataFrame:
    return tables.points(spark, d).where(points.valid()).select("host", "ordinal", "name", "value")


@query(f"with {tables.SNAPSHOTS} select host, observed_us, mountpoint, device from mounts where fstype in ('ext4', 'xfs', 'tmpfs', 'overlay')")
def p2_local_filesystems(spark: SparkSession, d: str) -> DataFrame:
    m = tables.snapshots(spark, d).select("host", "observed_us", F.explode("mounts").alias("m")).select("host", "observed_us", "m.*")
    return m.where(F.col("fstype").isin(*reshape.LOCAL_FILESYSTEMS)).select("host", "observed_us", "mountpoint", "device")


@query(f"with {tables.SNAPSHOTS} select observed_us, d.name from disks d join snaps s using (observed_us) where s.start_us is not null")
def p3_drop_sums_without_origin(spark: SparkSession, d: str) -> DataFrame:
    p = tables.snapshots(spark, d).select("observed_us", "start_us", F.lit("sum").alias("kind"), F.explode("disks").alias("x"))
    return p.where(points.with_origin()).select("observed_us", F.col("x.name").alias("name"))


@query(f"with {tables.POINTS} select host, ordinal, case when length(event_type) <= 256 then 'event=' || event_type || ';' else '' end || 'k=' || k as attributes from points")
def p9_bound_attributes(spark: SparkSession, d: str) -> DataFrame:
    return tables.points(spark, d).withColumn("attributes", points.bounded_attributes()).select("host", "ordinal", flat())


@query(f"""with {tables.POINTS} select host, name, kind, unit, min(ordinal)::int as first, array_to_string(list(round(value, 6)::decimal(18,2)::varchar order by ordinal), ',') as vals
from points where not isnan(value) and value >= 0 and (name like 'system.%' or name like 'host.%') group by all""")
def a2_group_metrics(spark: SparkSession, d: str) -> DataFrame:
    p = points.grouped(tables.points(spark, d).where(points.valid()), ["host"])
    return p.select("host", "name", "kind", "unit", "first", F.array_join(F.transform("points", lambda v: v.cast("decimal(18,2)").cast("string")), ",").alias("vals"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    p = tables.points(spark, d).withColumn("start_us", F.lit(1_700_000_000_000_000))
    return points.batches(p, ["host", "observed_us"], {"host.name": "h"}, 100, 4096)


_AROUND = """strlen('{"resourceMetrics":[{"resource":{"attributes":[{"key":"host.name","value":{"stringValue":"h"}}]},"scopeMetrics":[{"scope":{"name":"fleet.hostmetrics","version":"1"},"metrics":[]}]}]}')"""
_SIZE = f"({_AROUND} + coalesce(list_sum(list_transform(p[lo + 1 : hi], lambda x: x.cost + case when x.before <= lo then x.first else 0 end)), 0) - (len(list_filter(p[lo + 1 : hi], lambda x: x.cost > 0)) > 0)::int)"


@query(f"""with recursive {tables.POINTS},
told as (select *, (ordinal - 1) // 100 as chunk, not isnan(value) and value >= 0 and (name like 'system.%' or name like 'host.%') as good,
  '{{"name":"' || name || '","unit":"1",' || case when kind = 'sum' then '"sum":{{"dataPoints":[],"aggregationTemporality":2,"isMonotonic":true}}}}' else '"gauge":{{"dataPoints":[]}}}}' end as metric,
  '{{' || case when kind = 'sum' then '"startTimeUnixNano":"1700000000000000000",' else '' end || '"timeUnixNano":"0","asDouble":' || value || ',"attributes":['
    || case when kind = 'sum' then '{{"key":"_boot_time_unix","value":{{"stringValue":"1700000000"}}}},' else '' end
    || '{{"key":"event","value":{{"stringValue":"' || event_type || '"}}}},{{"key":"k","value":{{"stringValue":"' || k || '"}}}}]}}' as text from points),
placed as (select *, row_number() over (partition by host, chunk order by ordinal) as i from told),
linked as (select *, coalesce(lag(i) over (partition by host, chunk, case when good then metric end order by i), 0) as before from placed),
docs as (select host, chunk, list({{'before': before, 'cost': case when good then strlen(text) + 1 else 0 end, 'first': case when good then strlen(metric) else 0 end}} order by i) as p from linked group by all),
parts as (select host, chunk, p, 0 as lo, len(p) as hi from docs
  union all select host, chunk, p, case when half then lo + (hi - lo) // 2 else lo end, case when half then hi else lo + (hi - lo) // 2 end from
    (select *, unnest([false, true]) as half from parts where hi - lo > 1 and {_SIZE} > 4096)),
leaves as (select *, {_SIZE} as n_bytes from parts where hi - lo <= 1 or {_SIZE} <= 4096)
select host, chunk, (row_number() over (partition by host, chunk order by lo) - 1)::int as part, len(list_filter(p[lo + 1 : hi], lambda x: x.cost > 0))::int as n_points, n_bytes::int as n_bytes
from leaves where host not in (select host from leaves where n_bytes > 4096)""")
def a3_batch_points(spark: SparkSession, d: str) -> DataFrame:
    """Points in documents of at most 100 points and 4,096 bytes."""
    return _documents(spark, d).select("host", "chunk", "part", "n_points", F.octet_length("payload").alias("n_bytes"))


@query(f"""with {tables.POINTS} select host, name, kind, round(value, 6) as value, case when kind = 'sum' then '_boot_time_unix=1700000000;' else '' end || 'event=' || event_type || ';k=' || k as attributes
from points where not isnan(value) and value >= 0 and (name like 'system.%' or name like 'host.%')""")
def s3_flatten_otlp_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Points built into documents (S5), within bounds (A3), and read back."""
    return otlp.flatten_metrics(_documents(spark, d).select("host", "payload")).select("host", "name", "kind", F.round("value", 6).alias("value"), flat())


@query(f"""with {tables.POINTS} select host, name, count(*) as n_points, count(distinct host) as n_hosts, count(distinct name) as n_names
from points where not isnan(value) and value >= 0 and (name like 'system.%' or name like 'host.%') group by cube (host, name)""")
def a6_otlp_summary(spark: SparkSession, d: str) -> DataFrame:
    p = otlp.flatten_metrics(_documents(spark, d).select("host", "payload"))
    return otlp.summary(p.where("name is not null").select("host", "name"))


@query(f"""with {tables.POINTS}, c as (select host, name, count(*) as n from points group by all)
select host, (row_number() over (partition by host order by name))::int as ordinal, 'host.agent.' || name as name, n::double as value from c""")
def x8_self_telemetry_points(spark: SparkSession, d: str) -> DataFrame:
    c = tables.points(spark, d).groupBy("host", "name").agg(F.count("*").alias("n")).groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("name", "n"))).alias("counters"))
    return reshape.self_telemetry_points(c, ["host"]).select("host", "ordinal", "name", "value")
