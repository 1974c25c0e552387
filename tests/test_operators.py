"""Cases with known answers, as small tables."""

import json

from pyspark.sql import functions as F

from fleetgrain.functions import scalars
from fleetgrain.operators import admission, counters, delivery, logs, policy, reshape
from fleetgrain.operators import points as P
from fleetgrain.sources import files, otlp


def test_cpu_used_pct_rules(spark):
    a, b = [10.0, 0, 10, 70, 10, 0, 0, 0], [20.0, 0, 20, 80, 20, 0, 0, 0]
    second = 1_000_000
    cases = {"half": (a, b, second, 50.0), "no gap": (a, b, 0, None), "long": (a, b, 121 * second, None), "limit": (a, b, 120 * second, 50.0), "reset": (b, a, second, None), "still": (a, a, second, None)}
    rows = [(k, t, e, [float(x) for x in c]) for k, (p, q, gap, _) in cases.items() for t, e, c in ((1000, 1, p), (1000 + gap, 2, q))]
    got = counters.cpu_used_pct(spark.createDataFrame(rows, "host string, observed_us long, event_id long, cpu array<double>")).where("event_id = 2").collect()
    assert {r.host: r.used_pct for r in got} == {k: v[3] for k, v in cases.items()}


def test_points_that_are_no_points(spark):
    rows = [("system.a", float("nan")), ("system.b", float("inf")), ("host.c", -1.0), ("other.d", 1.0), ("host.e", 0.0)]
    df = spark.createDataFrame(rows, "name string, value double")
    assert [r.name for r in df.where(P.valid()).collect()] == ["host.e"]


def test_bounded_attributes_use_up_places(spark):
    held = {f"k{i:02}": "v" for i in range(20)} | {"a" * 65: "v", "b": "x" * 257}
    got = spark.createDataFrame([(held,)], "attributes map<string,string>").select(P.bounded_attributes().alias("a")).first().a
    assert sorted(got) == [f"k{i:02}" for i in range(14)]


def test_batches_hold_every_point_within_bounds(spark):
    rows = [("h", 0, 1_000_000, i + 1, "system.disk.io", "By", "sum", float(i), {"device": "nvme0n1", "direction": "read"}) for i in range(2001)]
    df = spark.createDataFrame(rows, "host string, observed_us long, start_us long, ordinal int, name string, unit string, kind string, value double, attributes map<string,string>")
    got = P.batches(df, ["host", "observed_us"], {"host.name": "h"}, 500, 65536).collect()
    assert sum(r.n_points for r in got) == 2001
    assert max(r.n_points for r in got) <= 500 and max(len(r.payload.encode()) for r in got) <= 65536
    metric = json.loads(got[0].payload)["resourceMetrics"][0]["scopeMetrics"][0]["metrics"][0]
    assert metric["sum"]["isMonotonic"] and metric["sum"]["aggregationTemporality"] == 2
    back = otlp.flatten_metrics(spark.createDataFrame(got).select("payload"))
    assert sorted(r.value for r in back.collect()) == [float(i) for i in range(2001)]


def test_one_oversize_point_fails_its_snapshot(spark):
    rows = [(h, 0, 1, i + 1, "host.x" + ("y" * 2000 if h == "bad" and i == 1 else ""), "1", "gauge", 1.0, {}) for h in ("good", "bad") for i in range(3)]
    df = spark.createDataFrame(rows, "host string, observed_us long, start_us long, ordinal int, name string, unit string, kind string, value double, attributes map<string,string>")
    assert {r.host for r in P.batches(df, ["host", "observed_us"], {}, 500, 1024).collect()} == {"good"}


def test_framing_offsets_and_rejects(spark):
    df = spark.createDataFrame([("f", "ok\r\n\n12345\nopen")], "file string, content string")
    got = logs.frame_lines(df, ["file"]).withColumn("why", logs.reject_reason(4)).orderBy("pos").collect()
    assert [(r.start_offset, r.end_offset, r.line, r.why) for r in got] == [(0, 4, "ok", None), (4, 5, "", "empty"), (5, 11, "12345", "too_long")]


def test_blank_responses_are_accepted(spark):
    df = spark.createDataFrame([("",), ("\t\r\n",), (" ",), (None,), ("[]",), ('{"partialSuccess":{"rejectedDataPoints":"2"}}',)], "body string")
    got = [tuple(r.p) for r in df.select(scalars.partial_success(F.lit("metrics"), F.col("body")).alias("p")).collect()]
    assert got == [("accepted", 0)] * 4 + [("rejected", 0), ("rejected", 2)]


def test_a_lost_cursor_falls_back(spark):
    entries = spark.createDataFrame([(h, k, f"{h}{k}", k * 1_000_000) for h in "abc" for k in range(4)], "host string, position long, cursor string, observed_us long")
    state = spark.createDataFrame([("a", "gone", 2_500_000), ("b", "b1", None)], "host string, cursor string, since_us long")
    kept = lambda start: sorted((r.host, r.position) for r in logs.resume_from(entries, state, start_at=start).collect())
    held = [("a", 2), ("a", 3), ("b", 2), ("b", 3)]
    assert kept("end") == held and kept("beginning") == held + [("c", k) for k in range(4)]


def test_chunks_without_valid_points_and_other_scripts(spark):
    rows = [("h", 0, 1, i + 1, "other.x" if i < 2 else "host.é", "1", "gauge", 1.0, {}) for i in range(3)]
    df = spark.createDataFrame(rows, "host string, observed_us long, start_us long, ordinal int, name string, unit string, kind string, value double, attributes map<string,string>")
    got = P.batches(df, ["host", "observed_us"], {}, 2, 4096).orderBy("chunk").collect()
    assert [r.n_points for r in got] == [0, 1] and "host.é" in got[1].payload


def test_runs_of_invalid_bytes_become_one_sign(spark):
    df = spark.createDataFrame([(bytearray(b"\xff\xfea\xc3"),), (bytearray("é".encode()),), (None,)], "b binary")
    assert [r[0] for r in df.select(scalars.valid_utf8(F.col("b"))).collect()] == ["�a�", "é", None]


def test_multiline_both_ways_agree(spark):
    text = "START one\n continuation\nx\ny\nz\nSTART two\nlast\n"
    lines = logs.frame_lines(spark.createDataFrame([("f", text), ("g", "no start\nSTART\n")], "file string, content string"), ["file"])
    one = logs.assemble_multiline(lines, ["file"], "^START", 3)
    two = logs.assemble_multiline_bytes(lines, ["file"], "^START", 3, 1 << 20)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    assert [r.body for r in one.where("file = 'f'").orderBy("start_offset").collect()] == ["START one\n continuation\nx", "y\nz", "START two\nlast"]
    capped = logs.assemble_multiline_bytes(lines, ["file"], "^START", 100, 12).where("file = 'f'").orderBy("start_offset")
    assert [r.body for r in capped.collect()] == ["START one", " continuation", "x\ny\nz", "START two", "last"][:2] + ["x\ny\nz", "START two", "last"]


def test_journal_entries(spark):
    e = {"MESSAGE": "paid", "__CURSOR": "c1", "__REALTIME_TIMESTAMP": "5", "_SYSTEMD_UNIT": "checkout.service", "PRIORITY": "4", "_PID": "7"}
    rows = [json.dumps(e), json.dumps(e | {"MESSAGE": ["a"]}), json.dumps({"MESSAGE": "x"}), json.dumps(e | {"__REALTIME_TIMESTAMP": " 5", "_SYSTEMD_UNIT": "u" * 257}), "not json"]
    got = logs.parse_journal(spark.createDataFrame([(i, v, 9) for i, v in enumerate(rows)], "i int, value string, fallback_us long")).orderBy("i").collect()
    assert [r.ok for r in got] == [True, False, False, True, False]
    assert (got[0].service, got[0].severity, got[0].observed_us, got[0].attributes["process.pid"]) == ("checkout", "WARN", 5, "7")
    assert (got[3].service, got[3].observed_us) == ("", 9)


def test_identity_cases(spark):
    ec2 = (True, "aws", "aws_ec2", "i-0123456789abcdef0")
    rows = [("explicit", "label", ec2, "local"), ("ec2", "", ec2, "local"), ("machine", "", None, " machine-01\n"), ("none", "", None, ""), ("label only", "label", None, None), ("unverified", "", (False, *ec2[1:]), "local")]
    df = spark.createDataFrame(rows, "k string, configured string, evidence struct<verified:boolean,provider:string,platform:string,instance_id:string>, machine string")
    got = {r.k: (r.r.agent_id, r.r.host_id, r.r.error) for r in df.select("k", scalars.resolve_identity(F.col("configured"), F.col("evidence"), F.col("machine")).alias("r")).collect()}
    assert got == {"explicit": ("label", ec2[3], None), "ec2": (ec2[3], ec2[3], None), "machine": ("machine-01", "machine-01", None), "none": (None, None, "no_identity"), "label only": ("label", "", None), "unverified": ("local", "local", None)}


def test_scope_hashes_differ_by_signal(spark):
    row = spark.range(1).select(*[scalars.scope_hash(F.lit("b"), F.lit("o"), F.lit("h"), F.lit(""), F.lit(""), t) for t in (scalars.METRICS_SCOPE_TAG, scalars.LOGS_SCOPE_TAG)], scalars.scope_hash(F.lit("b\n"), F.lit("o"), F.lit("h"), F.lit(""), F.lit(""))).first()
    assert row[0] != row[1] and len(row[0]) == 64 and row[2] is None


def test_attempt_outcomes(spark):
    cases = [("metrics", None, 201, "", "accepted"), ("metrics", None, 200, '{"data":{"partialSuccess":{"rejectedDataPoints":"0"}}}', "accepted"), ("metrics", None, 401, "", "unauthorized"), ("metrics", None, 429, "", "retry"), ("metrics", None, 422, "", "rejected"), ("metrics", None, 200, '{"partialSuccess":{"rejectedDataPoints":"2"}}', "rejected"), ("metrics", None, 200, "not-json", "rejected"), ("logs", None, 200, '{"partialSuccess":{"rejectedLogRecords":2}}', "accepted"), ("logs", "tls", 0, "", "rejected"), ("logs", "timeout", 0, "", "retry"), ("logs", None, 505, "", "rejected"), ("metrics", None, 200, '{"partialSuccess":{"rejectedDataPoints":"x"}}', "rejected")]
    df = spark.createDataFrame([(i, "h", s, i, 1, e, c, b) for i, (s, e, c, b, _) in enumerate(cases)], "i int, host string, signal string, batch_id long, attempt int, error string, status int, body string")
    assert [r.outcome for r in delivery.classified(df).orderBy("i").collect()] == [c[-1] for c in cases]


def test_batches_end_or_exhaust(spark):
    rows = [("h", "metrics", b, i + 1, None, c, "") for b, codes in ((1, (429, 201)), (2, (503, 503, 503, 503, 200)), (3, (422,)), (4, (429,))) for i, c in enumerate(codes)]
    df = spark.createDataFrame(rows, "host string, signal string, batch_id long, attempt int, error string, status int, body string")
    got = {r.batch_id: (r.outcome, r.retries) for r in delivery.batch_outcomes(delivery.classified(df)).collect()}
    assert got == {1: ("accepted", 1), 2: ("exhausted", 3), 3: ("rejected", 0), 4: ("pending", 0)}


def test_retry_after(spark):
    rows = [("metrics", "1800", 0, 1800.0), ("logs", "7200", 0, 1800.0), ("metrics", "Mon, 01 Jan 2024 01:00:00 GMT", 0, 3600.0), ("metrics", "x", 3, 8.0), ("metrics", None, 9, 30.0)]
    rows += [("metrics", h, 0, 3600.0) for h in ("Monday, 01-Jan-24 01:00:00 GMT", "Mon Jan  1 01:00:00 2024")] + [("metrics", "Mon, 01 Jan 2024 01:00:00 EST", 1, 2.0)]
    df = spark.createDataFrame(rows, "signal string, h string, attempt int, want double")
    got = df.select("want", scalars.retry_delay(F.col("signal"), F.col("h"), F.col("attempt"), F.to_timestamp(F.lit("2024-01-01 00:00:00"))).alias("d")).collect()
    assert all(r.want == r.d for r in got)


def test_quota_skips_what_does_not_fit(spark):
    rows = [("s", 1, 1, "put", 20000), ("s", 2, 2, "put", 20000), ("s", 3, 3, "put", 100), ("s", 4, 1, "ack", 0), ("s", 5, 4, "put", 20000)]
    df = spark.createDataFrame(rows, "scope string, at long, seq long, event string, envelope_bytes long")
    got = {r.seq: r.admitted for r in admission.quota_admission(df, 8, 16384 + 4096 + 32768).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True}


def test_acks_are_for_the_head_once(spark):
    spool = spark.createDataFrame([("s", 1), ("s", 2)], "scope string, seq long")
    acks = spark.createDataFrame([("s", 1, 1), ("s", 2, 2), ("s", 2, 3)], "scope string, seq long, ack_order long")
    assert sorted((r.ack_order, r.valid) for r in admission.valid_acks(spool, acks).collect()) == [(1, True), (2, True), (3, False)]


def test_policies_in_order(spark):
    rows = [(1, 1, "m"), (2, 2, "mt"), (3, 3, "m"), (4, 3, "m"), (5, 2, "mt"), (6, 3, "l")]
    df = spark.createDataFrame([("i", a, v, c) for a, v, c in rows], "installation string, arrival long, version long, content string")
    assert [r.decision for r in policy.accept_policies(df).orderBy("arrival").collect()] == ["accept", "accept", "accept", "noop", "reject", "reject"]


def test_proc_stat(spark):
    df = spark.createDataFrame([("cpu  1 2 3 4 5 6 7 8 9\ncpu0 1\nbtime 12\n",), ("btime 0\n",), ("cpu 1 2 x 4 5 6 7 8\n",)], "text string")
    got = files.parse_proc_stat(df).collect()
    assert got[0].cpu == [k / 100 for k in range(1, 9)] and got[0].start_us == 12_000_000
    assert got[1].cpu is None and got[1].start_us is None and got[2].cpu is None


def test_globs(spark):
    df = spark.createDataFrame([("a.log",), ("b.txt",), ("x{a}.log",), ("old.log",)], "n string")
    assert sorted(r.n for r in df.where(files.matching(F.col("n"), ["*.log"], ["old*"])).collect()) == ["a.log", "x{a}.log"]


def test_compact_json_keeps_strings(spark):
    df = spark.createDataFrame([('{ "a" : " b \\" c" ,\n"d": 1.50 }',), ('{"x":1}',)], "t string")
    assert [r[0] for r in df.select(scalars.compact_json(F.col("t"))).collect()] == ['{"a":" b \\" c","d":1.50}', '{"x":1}']


def test_failed_mounts_keep_their_place(spark):
    m = [("/b", "d1", "ext4", 1, 1, False), ("/a", "d2", "nfs", 1, 1, True), ("/c", "d3", "xfs", 5, 6, True), ("/b", "d0", "ext4", 2, 3, True), ("/d", "d4", "zfs", 1, 1, True)]
    df = spark.createDataFrame([(m,)], "mounts array<struct<mountpoint:string,device:string,fstype:string,used:long,free:long,ok:boolean>>")
    got = df.select(F.explode(reshape.filesystem_points(reshape.local_mounts(), 2)).alias("p")).select("p.*").collect()
    assert [(r.attributes["device"], r.value) for r in got] == [("d0", 2.0), ("d0", 3.0), ("d3", 5.0), ("d3", 6.0)]


def test_log_documents_round_trip(spark):
    rows = [("hi", "s", "file", "d/a.log", "1:2", 0, 3, 5, None, None, "WARN", {"k": "v", "e": ""}), ("yo", "j", "journald", None, None, None, None, 6, "svc", "prod", None, {})]
    df = spark.createDataFrame(rows, "body string, source_id string, source_type string, relative_path string, file_identity string, start_offset long, end_offset long, observed_us long, service_name string, environment string, severity_text string, attributes map<string,string>")
    doc = otlp.log_document({c: F.col(c) for c in df.columns}, F.create_map(F.lit("service.name"), F.lit("agent"), F.lit("host.name"), F.lit("h")))
    got = otlp.flatten_logs(df.select(doc.alias("payload"))).orderBy("time_nano").collect()
    assert got[0].attributes["log.file.record_end_offset"] == "3" and got[0].attributes["log.file.name"] == "a.log" and "e" not in got[0].attributes
    assert got[1].scope == "fleet.journald" and got[1].resource["service.name"] == "svc" and "log.file.path" not in got[1].attributes


def test_log_files_of_a_folder(spark, tmp_path):
    for name in ("b.log", "a.log", "c.txt", "old.log"):
        (tmp_path / name).write_text(f"{name}\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.log").write_text("x\n")
    got = files.read_log_files(spark, f"file://{tmp_path}/*", ["*.log"], ["old*"], 1).collect()
    assert [(r.relative_path, bytes(r.content)) for r in got] == [("a.log", b"a.log\n")]


def test_spool_goes_on_from_its_base(spark, tmp_path):
    base = spark.createDataFrame([("s", 4)], "scope string, seq long")
    new = files.spooled(spark.createDataFrame([("s", "{}", 2), ("s", "[]", 1), ("t", "1", 1)], "scope string, payload string, arrival long"), base)
    files.write_spool(new, f"file://{tmp_path}/spool")
    got = sorted((r.scope, r.seq, r.payload, r.name) for r in files.read_spool(spark, f"file://{tmp_path}/spool").collect())
    assert got == [("s", 5, "[]", "5".zfill(20)), ("s", 6, "{}", "6".zfill(20)), ("t", 1, "1", "1".zfill(20))]


def test_counter_window_shuffles_once(spark, small):
    from fleetgrain.sources import tables

    plan = counters.cpu_used_pct(tables.counter_samples(spark, small))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def test_caps_do_not_shuffle(spark, small):
    from fleetgrain.sources import tables

    snapshots = tables.snapshots(spark, small)
    one, two = (df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for df in (snapshots, reshape.snapshot_points(snapshots.withColumn("used_pct", F.lit(None).cast("double")))))
    assert one == two


def test_devices_come_by_one_shuffle_of_lines(spark, small):
    from fleetgrain.plans import catalog
    from fleetgrain.sources import tables

    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert shuffles(tables.snapshots(spark, small)) == 2
        # readings by host, then by snapshot, and the lines
        assert shuffles(catalog.QUERIES["t4_cap_sample"](spark, small)) == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_a_device_with_nulls(spark, tmp_path):
    from fleetgrain.sources import tables

    spark.createDataFrame([(1, 10, 2, None), (1, 5, 7, 2), (1, None, 3, 2), (1, None, None, None)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = spark.createDataFrame([(1,), (2,)], "observed_us long")
    got = {r.observed_us: r for r in tables.devices(tables.with_lines(rows, spark, str(tmp_path))).collect()}
    assert got[2].disks is got[2].nets is got[2].mounts is None
    assert {(d.name, d.read_count, d.write_count, d.in_progress) for d in got[1].disks} == {("sd2", 5, 10, 2), (None, 10, 2, 2)}
    assert {(n.name, n.rx_packets, n.tx_packets, n.rx_errs) for n in got[1].nets} == {("eth2", 15, 9, 2), ("eth3", None, 3, 1), (None, None, None, 1)}
    assert {(m.mountpoint, m.device, m.used, m.free) for m in got[1].mounts} == {("/mnt2", "dev5", 7, 5), ("/mnt2", None, 3, None), (None, "dev10", 2, 10), (None, None, None, None)}


def test_sample_without_a_cpu_reading(spark):
    schema = """host long, observed_us long, start_us long, cpu array<double>, mem struct<total:long,available:long>, load struct<l1:double,l5:double,l15:double>, disks array<struct<name:string,read_bytes:long,read_count:long,
    read_ms:long,write_bytes:long,write_count:long,write_ms:long,in_progress:long>>, nets array<struct<name:string,rx_bytes:long,tx_bytes:long,rx_packets:long,tx_packets:long,rx_errs:long,tx_errs:long,rx_drops:long,tx_drops:long>>,
    mounts array<struct<mountpoint:string,device:string,fstype:string,used:long,free:long,ok:boolean>>, stats map<string,long>"""
    disk = [("sda", 1, 1, 1, 1, 1, 1, 3)]
    first, later = [10.0, 0.0, 10.0, 70.0, 10.0, 0.0, 0.0, 0.0], [20.0, 0.0, 20.0, 80.0, 20.0, 0.0, 0.0, 0.0]
    rows = [(1, at, 5, cpu, None, None, disk, [], [], {"scrapes": at}) for at, cpu in ((1, first), (2, None), (3, later))]
    used = counters.with_cpu_used_pct(spark.createDataFrame(rows, schema), tie="observed_us")
    got = {}
    for r in reshape.snapshot_points(used, telemetry="stats").orderBy("observed_us", "ordinal").collect():
        got.setdefault(r.observed_us, []).append((r.name, r.value, r.attributes.get("collector")))
    # the lost reading has no origin, so no sums; the next reading is compared with the one before it
    assert got[2] == [("system.disk.pending_operations", 3.0, None), *[("host.agent.collection.issue", 1.0, c) for c in ("cpu", "memory", "load")], ("host.agent.scrapes", 2.0, None)]
    assert [p[:2] for p in got[3][8:10]] == [("host.cpu.used_pct", 50.0), ("system.cpu.utilization", 0.5)]
    assert sum(n == "system.disk.io" for n, _, _ in got[1]) == 2


def test_counters_of_both_signals(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, "host long, us long, " + schema)
    tries = [(1, 0, "b", 1, None, 429, ""), (1, 0, "b", 2, "timeout", None, None), (1, 70_000_000, "b", 3, None, 503, ""), (1, 70_000_000, "b", 4, None, 500, ""), (1, 0, "c", 1, None, 200, ""), (1, 0, "c", 2, None, 200, ""), (None, 0, "e", 1, None, 403, "")]
    attempts = frame([(h, us, "metrics", *rest) for h, us, *rest in tries], "signal string, batch_id string, attempt int, error string, status int, body string")
    scrapes = frame([(1, 0, 2, True, False), (1, 0, None, None, None)], "n_issues int, failed boolean, oversize boolean")
    puts, spooled = frame([(1, 0, r) for r in ("queued", "full", "error")], "result string"), frame([(1, 0, True), (1, 0, False)], "ok boolean")
    rows = delivery.delivery_increments(delivery.classified(attempts), scrapes, puts, spooled, ["host", "us"])
    got = {r.host: {k: v for k, v in r.asDict().items() if v and k != "host"} for r in delivery.delivery_counters(rows, ["host"]).collect()}
    # three further attempts and an exhausted cycle; nothing counts after a batch's final attempt
    assert got[1] == {
        "accepted_records": 3, "queued_records": 1, "retried_records": 4, "delivered_records": 1, "corrupt_records": 1, "delivery_paused": 1, "scrapes": 2, "read_errors": 3, "queue_rejected": 2,
        "batches_accepted": 1, "export_failures": 5, "retries": 3, "throttles": 1, "dropped_batches": 2,
    }
    assert got[None] == {"export_failures": 1, "auth_failures": 1, "delivery_paused": 1}
    body = '{"partialSuccess":{"rejectedLogRecords":2}}'
    sent = frame([(1, 0, "logs", "x", 1, None, 200, body), (1, 0, "logs", "y", 1, None, 200, "")], "signal string, batch_id string, attempt int, error string, status int, body string")
    files = frame([(1, 0, True, None), (1, 0, True, "permission"), (1, 0, True, "checkpoint")], "open boolean, error string")
    lines, groups = frame([(1, 0, None), (1, 0, "empty")], "reason string"), frame([(1, 0, 1)], "n long")
    journal = frame([(1, 0, None, None), (1, 0, None, "permission"), (1, 0, None, "checkpoint"), (1, 0, "empty", None)], "reason string, error string")
    kept = frame([(1, 0, r) for r in ("queued", "existed", "error")], "result string")
    more = delivery.log_increments(delivery.classified(sent), files, lines, groups, journal, kept, ["host", "us"])
    assert {k: v for k, v in delivery.log_counters(more, ["host"]).first().asDict().items() if k != "host"} == {
        "files_discovered": 1, "files_open": 1, "records_read": 5, "records_accepted": 1, "records_queued": 1, "records_delivered": 1, "records_retried": 0, "records_dropped": 4, "records_rejected_local": 2,
        "records_rejected_server": 2, "permission_errors": 2, "checkpoint_errors": 2, "queue_rejected": 1, "authentication_paused": 0, "multiline_flushes": 1, "journal_records_read": 3, "journal_reader_errors": 1,
        "journal_checkpoint_errors": 1,
    }
    report = {(r.host, r.minute_us): r for r in delivery.minute_report(delivery.report_increments(rows, more, ["host", "us"]), ["host"]).collect()}
    assert set(report) == {(1, 0), (1, 60_000_000), (None, 0)}
    assert (report[1, 0].retries, report[1, 60_000_000].retries, report[1, 0].logs_records_read, report[1, 60_000_000].logs_records_read) == (2, 1, 5, 0)


def test_quota_goes_through_many_scopes_without_a_call_for_each(spark):
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = [(f"s{i}" if i else None, at, at if event == "put" else 2, event, 4096) for i in range(50) for at, event in ((1, "put"), (2, "put"), (3, "put"), (4, "ack"), (5, "put"))]
    df = spark.createDataFrame(rows[::-1], "scope string, at long, seq long, event string, envelope_bytes long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)  # scopes go on from batch to batch
    try:
        out = admission.quota_admission(df, 2, 1 << 20)
        got = sorted((r.scope or "", r.seq, r.admitted) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert got == sorted((f"s{i}" if i else "", seq, seq != 3) for i in range(50) for seq in (1, 2, 3, 5))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "MapInArrow" in plan
