"""Telemetry read from the warehouse's tables: each adapter is a DataFrame here and a common table expression in SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in spark.checkpoint.dir; where that is unset, in a temporary folder on a local master, an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{_OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix='spark-shared-'))}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str = "ts"):
    """Microseconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")


def counter_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """host, observed_us, start_us, cpu (8 cumulative seconds that start over at each boot)."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("host"), "event_id", micros().alias("us"))
    host = Window.partitionBy("host").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("boot", F.sum((F.col("event_id") % 50 == 0).cast("long")).over(host))
    life = Window.partitionBy("host", "boot").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    cpu = F.array(*[F.sum((F.col("event_id") * (i + 3)) % 97).over(life).cast("double") for i in range(8)])
    return e.select("host", F.expr("us div 600").alias("observed_us"), (F.col("boot") * 1000000).alias("start_us"), "event_id", cpu.alias("cpu"))


COUNTERS = """
ce as (select user_id as host, event_id, epoch_us(ts) as us from events),
cb as (select *, sum(case when event_id % 50 = 0 then 1 else 0 end) over (partition by host order by us, event_id rows unbounded preceding) as boot from ce),
counters as (select host, us // 600 as observed_us, (boot * 1000000)::bigint as start_us, event_id,
  [sum((event_id * 3) % 97) over w, sum((event_id * 4) % 97) over w, sum((event_id * 5) % 97) over w, sum((event_id * 6) % 97) over w,
   sum((event_id * 7) % 97) over w, sum((event_id * 8) % 97) over w, sum((event_id * 9) % 97) over w, sum((event_id * 10) % 97) over w]::double[] as cpu
  from cb window w as (partition by host, boot order by us, event_id rows unbounded preceding))"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """host, observed_us, ordinal, name, unit, kind, value, attributes: events as metric points, some of them invalid."""
    e = table(spark, sf_dir, "events").withColumn("us", micros())
    name = F.when(F.col("event_id") % 13 == 0, F.concat(F.lit("app."), "event_type")).when(F.col("event_id") % 2 == 0, F.concat(F.lit("system."), "event_type")).otherwise(F.concat(F.lit("host."), "event_type"))
    value = F.when(F.col("event_id") % 17 == 0, -F.col("value")).when(F.col("event_id") % 19 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    snapshot = Window.partitionBy("user_id").orderBy("us", "event_id")
    return e.select(
        F.col("user_id").alias("host"),
        F.lit(0).cast("long").alias("observed_us"),
        F.row_number().over(snapshot).alias("ordinal"),
        name.alias("name"),
        F.lit("1").alias("unit"),
        F.when(F.col("event_id") % 3 == 0, "sum").otherwise("gauge").alias("kind"),
        value.alias("value"),
        F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("event"), "event_type").alias("attributes"),
    )


POINTS = """
points as (select user_id as host, 0::bigint as observed_us, (row_number() over (partition by user_id order by epoch_us(ts), event_id))::int as ordinal,
  case when event_id % 13 = 0 then 'app.' when event_id % 2 = 0 then 'system.' else 'host.' end || event_type as name, '1' as unit,
  case when event_id % 3 = 0 then 'sum' else 'gauge' end as kind,
  case when event_id % 17 = 0 then -value when event_id % 19 = 0 then 'nan'::double else value end as value,
  json_extract_string(props, '$.k') as k, event_type from events)"""


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """host, observed_us, start_us and cpu (null for some), mem, load: orders as host snapshots without their devices."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("host"),
        F.col("o_orderkey").alias("observed_us"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey") * 1000000).alias("start_us"),
        F.when(F.col("o_orderkey") % 13 != 0, F.array(*[(F.col("o_orderkey") % 9000 * (i + 3) + F.col("o_orderkey") * (i + 1) % 5).cast("double") for i in range(8)])).alias("cpu"),
        F.when(F.col("o_orderkey") % 7 != 0, F.struct((F.col("o_orderkey") % 1000).alias("total"), (F.col("o_custkey") % 700).alias("available"))).alias("mem"),
        F.when(F.col("o_orderkey") % 11 != 0, F.struct((F.col("o_orderkey") % 10 / 2).alias("l1"), (F.col("o_orderkey") % 6 / 4).alias("l5"), (F.col("o_orderkey") % 4 / 8).alias("l15"))).alias("load"),
    )


def with_lines(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows (observed_us, ...) with the lines of their order, which pass one shuffle as three numbers each."""
    line = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(line).alias("lines"))
    return rows.join(lines, F.col("observed_us") == F.col("l_orderkey"), "left").drop("l_orderkey")


def _alike(key: Callable[[Column], Column]) -> Column:
    """lines in parts of one key each."""
    return F.transform(F.array_distinct(F.transform("lines", key)), lambda k: F.filter("lines", lambda x: key(x).eqNullSafe(k)))


def _total(part: Column, field: str) -> Column:
    """The sum of a field, null if it is null in all of part."""
    return F.aggregate(part, F.lit(None).cast("long"), lambda a, x: F.when(x[field].isNull(), a).otherwise(F.coalesce(a, F.lit(0)) + x[field]))


def devices(rows: DataFrame) -> DataFrame:
    """rows with disks, nets and mounts in place of lines; null where an order has none."""
    kinds = F.array(*map(F.lit, ("ext4", "xfs", "nfs", "tmpfs", "cifs", "overlay")))
    summed = lambda part: F.struct(part[0].alias("of"), _total(part, "p").alias("p"), _total(part, "s").alias("s"), F.size(part).cast("long").alias("c"))

    def disk(d: Column) -> Column:
        return F.struct(F.concat(F.lit("sd"), d["of"]["n"]).alias("name"), (d["p"] * 512).alias("read_bytes"), d["p"].alias("read_count"), d["s"].alias("read_ms"), (d["s"] * 512).alias("write_bytes"), d["s"].alias("write_count"), d["p"].alias("write_ms"), d["c"].alias("in_progress"))

    def net(d: Column) -> Column:
        none = F.lit(0).cast("long")
        return F.struct(F.concat(F.lit("eth"), d["of"]["s"] % 5).alias("name"), (d["p"] * 100).alias("rx_bytes"), (d["s"] * 100).alias("tx_bytes"), d["p"].alias("rx_packets"), d["s"].alias("tx_packets"), d["c"].alias("rx_errs"), none.alias("tx_errs"), none.alias("rx_drops"), d["c"].alias("tx_drops"))

    def mount(d: Column) -> Column:
        part = d["of"]["p"]
        return F.struct(F.concat(F.lit("/mnt"), d["of"]["n"] % 4).alias("mountpoint"), F.concat(F.lit("dev"), part).alias("device"), F.get(kinds, (part % 6).cast("int")).alias("fstype"), d["s"].alias("used"), part.cast("long").alias("free"), (d["s"] % 11 != 0).alias("ok"))

    each = [("disks", lambda x: x["n"], disk), ("nets", lambda x: x["s"] % 5, net), ("mounts", lambda x: F.struct((x["n"] % 4).alias("n"), x["p"].alias("p")), mount)]
    return rows.withColumns({name: F.transform(F.transform(_alike(key), summed), of) for name, key, of in each}).drop("lines")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """host, observed_us, start_us and cpu (null for some), mem, load, disks, nets, mounts: orders as host snapshots, their lines as devices."""
    return devices(with_lines(readings(spark, sf_dir), spark, sf_dir))


SNAPSHOTS = """
snaps as (select o_custkey as host, o_orderkey as observed_us, case when o_orderkey % 5 <> 0 then o_custkey * 1000000 end as start_us,
  case when o_orderkey % 13 <> 0 then list_transform(range(8), lambda i: ((o_orderkey % 9000) * (i + 3) + (o_orderkey * (i + 1)) % 5)::double) end as cpu,
  case when o_orderkey % 7 <> 0 then o_orderkey % 1000 end as total, case when o_orderkey % 7 <> 0 then o_custkey % 700 end as available,
  case when o_orderkey % 11 <> 0 then (o_orderkey % 10) / 2.0::double end as l1, case when o_orderkey % 11 <> 0 then (o_orderkey % 6) / 4.0::double end as l5,
  case when o_orderkey % 11 <> 0 then (o_orderkey % 4) / 8.0::double end as l15 from orders),
disks as (select o.o_custkey as host, l_orderkey as observed_us, 'sd' || l_linenumber as name, sum(l_partkey)::bigint as p, sum(l_suppkey)::bigint as s, count(*) as c
  from lineitem join orders o on o_orderkey = l_orderkey group by all),
nets as (select o.o_custkey as host, l_orderkey as observed_us, 'eth' || (l_suppkey % 5) as name, sum(l_partkey)::bigint as p, sum(l_suppkey)::bigint as s, count(*) as c
  from lineitem join orders o on o_orderkey = l_orderkey group by all),
mounts as (select o.o_custkey as host, l_orderkey as observed_us, '/mnt' || (l_linenumber % 4) as mountpoint, 'dev' || l_partkey as device,
  ['ext4', 'xfs', 'nfs', 'tmpfs', 'cifs', 'overlay'][l_partkey % 6 + 1] as fstype, sum(l_suppkey)::bigint as used, l_partkey::bigint as free, sum(l_suppkey) % 11 <> 0 as ok
  from lineitem join orders o on o_orderkey = l_orderkey group by o.o_custkey, l_orderkey, l_linenumber % 4, l_partkey)"""
