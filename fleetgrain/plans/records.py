"""Queries of the log, admission, delivery, policy and evidence operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import admission, delivery, evidence, identity, logs, policy
from ..sources import files, otlp, tables

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


# ---- log files ------------------------------------------------------------------------------------------------------

_TAIL = "case when doc_id % 7 = 0 then {nl}||{nl} when doc_id % 4 <> 0 then {nl} else '' end"
_FILES = f"files as (select printf('%x', doc_id) as file, source, doc_id, text || {_TAIL.format(nl='chr(10)')} as content from documents)"
_LINES = f"""{_FILES}, raw as (select file, unnest(string_split(content, chr(10))) as line, unnest(range(0, len(string_split(content, chr(10)))))::int as pos, len(string_split(content, chr(10))) as n from files),
ends as (select *, sum(strlen(line) + 1) over (partition by file order by pos rows unbounded preceding)::bigint as end_offset from raw),
lines as (select file, pos, end_offset - strlen(line) - 1 as start_offset, end_offset, regexp_replace(line, '\\r$', '') as line from ends where pos < n - 1)"""


def log_files(spark: SparkSession, d: str) -> DataFrame:
    """file, source, doc_id, content: documents as log files; some end in an open line, some in an empty one."""
    docs = tables.table(spark, d, "documents")
    return docs.select(F.lower(F.hex("doc_id")).alias("file"), "source", "doc_id", F.concat("text", F.when(F.col("doc_id") % 7 == 0, "\n\n").when(F.col("doc_id") % 4 != 0, "\n").otherwise("")).alias("content"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return logs.frame_lines(log_files(spark, d), ["file"])


@query(f"with {_LINES} select file, pos, start_offset, end_offset, md5(line) as line from lines")
def w3_frame_lines(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).withColumn("line", F.md5(F.col("line").cast("binary")))


@query(f"with {_LINES} select file, pos, case when end_offset - start_offset > 256 then 'too_long' when line = '' then 'empty' end as reason from lines")
def p7_reject_lines(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("file", "pos", logs.reject_reason(256).alias("reason"))


@query(f"""with {_LINES}, k as (select *, sum(case when regexp_matches(line, '^[A-F]') then 1 else 0 end) over (partition by file order by pos) as g from lines where end_offset - start_offset <= 4096),
r as (select *, (row_number() over (partition by file, g order by pos) - 1) // 5 as s from k),
m as (select file, g, s, min(start_offset) as start_offset, max(end_offset) as end_offset, count(*)::int as n_lines, md5(string_agg(line, chr(10) order by pos)) as body, max(pos) as last from r group by file, g, s)
select file, start_offset, end_offset, n_lines, body, last = max(last) over (partition by file) as open from m""")
def w4_assemble_multiline(spark: SparkSession, d: str) -> DataFrame:
    kept = _lines(spark, d).where(~F.coalesce(logs.reject_reason(4096, empty=False) == "too_long", F.lit(False)))
    return logs.assemble_multiline(kept, ["file"], "^[A-F]", 5).withColumn("body", F.md5(F.col("body").cast("binary")))


@query(f"""with recursive {_LINES}, o as (select *, strlen(line) as size, regexp_matches(line, '^[A-F]') as start from lines),
fold as (select file, pos, 0 as g, 1 as n, size::bigint as bytes from o where pos = 0
  union all select file, pos, case when cut then g + 1 else g end, case when cut then 1 else n + 1 end, case when cut then size else bytes + 1 + size end
  from (select f.g, f.n, f.bytes, o.file, o.pos, o.size, f.n >= 5 or f.bytes + 1 + o.size > 600 or o.start as cut from fold f join o on o.file = f.file and o.pos = f.pos + 1))
select file, min(start_offset) as start_offset, max(end_offset) as end_offset, count(*)::int as n_lines, md5(string_agg(line, chr(10) order by pos)) as body,
  max(pos) = max(max(pos)) over (partition by file) as open from fold join o using (file, pos) group by file, g""")
def w4_assemble_multiline_bytes(spark: SparkSession, d: str) -> DataFrame:
    return logs.assemble_multiline_bytes(_lines(spark, d), ["file"], "^[A-F]", 5, 600).withColumn("body", F.md5(F.col("body").cast("binary")))


@query("""with named as (select doc_id // 250 as file, string_agg(coalesce(text, '') || chr(10), '' order by doc_id) as content from documents group by 1),
raw as (select file, unnest(string_split(content, chr(10))) as line, unnest(range(0, len(string_split(content, chr(10)))))::bigint as pos, len(string_split(content, chr(10))) as n from named),
ends as (select *, sum(strlen(line) + 1) over (partition by file order by pos rows unbounded preceding)::bigint as end_offset from raw)
select file, pos, end_offset - strlen(line) - 1 as start_offset, end_offset, md5(regexp_replace(line, '\r$', '')) as line from ends where pos < n - 1""")
def w3_read_lines(spark: SparkSession, d: str) -> DataFrame:
    """Documents landed as log files of up to 250 texts each, framed by byte ranges of the files."""
    path = tables.shared_folder(spark, "log-files")
    docs = tables.table(spark, d, "documents").select(F.expr("doc_id div 250").alias("file"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs.repartition("file").sortWithinPartitions("file", "doc_id").select("file", "text").write.partitionBy("file").text(path)
    lines = files.read_lines(spark, path)
    file = F.regexp_extract("path", "file=([0-9]+)", 1).cast("long")
    return lines.select(file.alias("file"), "pos", "start_offset", "end_offset", F.md5(F.col("line").cast("binary")).alias("line"))


_SEEN = """seen as (select user_id as file, epoch_us(ts) as us, event_id, (value * 10)::bigint as size, (event_id % 40) * 10 as committed, event_id % 3 = 0 as reopened, event_type as fingerprint from events)"""


@query(f"""with {_SEEN}, c as (select *, coalesce(size < committed, false) as restart, coalesce(reopened and lag(fingerprint) over (partition by file order by event_id) <> fingerprint, false) as other from seen)
select file, event_id, restart, sum(case when restart or other then 1 else 0 end) over (partition by file order by event_id rows unbounded preceding)::bigint as generation from c""")
def w5_file_generations(spark: SparkSession, d: str) -> DataFrame:
    e = tables.table(spark, d, "events")
    seen = e.select(F.col("user_id").alias("file"), "event_id", F.round(F.col("value") * 10).cast("long").alias("size"), (F.col("event_id") % 40 * 10).alias("committed"), (F.col("event_id") % 3 == 0).alias("reopened"), F.col("event_type").alias("fingerprint"))
    return logs.file_generations(seen, ["file"], "event_id").select("file", "event_id", "restart", "generation")


@query(f"with {_FILES} select file, case when doc_id % 3 = 0 then doc_id * 2 else strlen(content) end as start from files")
def p6_start_at_end(spark: SparkSession, d: str) -> DataFrame:
    f = log_files(spark, d)
    state = f.where("doc_id % 3 = 0").select("file", (F.col("doc_id") * 2).alias("offset"))
    return logs.start_offsets(f.select("file", F.octet_length("content").cast("long").alias("size")), state, ["file"], "end").select("file", "start")


@query(f"with {_FILES} select file, row_number() over (partition by source order by file) <= 32 as active from files")
def t6_cap_open_files(spark: SparkSession, d: str) -> DataFrame:
    return logs.active_files(log_files(spark, d), "source", "file").select("file", "active")


@query(f"with {_FILES} select file, sha256(unhex(left(hex(encode(content)), 512))) as fingerprint from files")
def h3_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return log_files(spark, d).select("file", scalars.fingerprint(F.col("content")).alias("fingerprint"))


@query(f"with {_LINES} select file, pos, sha256('{scalars.FILE_TAG}' || chr(0) || 'src' || chr(0) || file || chr(0) || '0' || chr(0) || start_offset || chr(0) || end_offset) as admission_id from lines")
def h1_admission_id(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("file", "pos", scalars.file_admission_id(F.lit("src"), F.col("file"), F.lit(0), F.col("start_offset"), F.col("end_offset")).alias("admission_id"))


@query("select doc_id, printf('%x:%x', doc_id, doc_id * 7) as identity from documents")
def h4_file_identity(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "documents").select("doc_id", scalars.file_identity(F.col("doc_id"), F.col("doc_id") * 7).alias("identity"))


@query("select doc_id, md5(text || case doc_id % 3 when 0 then chr(65533) || 'z' when 1 then 'x' || chr(65533) || 'y' || chr(65533) else '' end) as text from documents")
def h5_valid_utf8(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of all texts, to most of which bytes that are no UTF-8 were added: a run of them becomes one sign."""
    broken = F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("FFFE7A"))).when(F.col("doc_id") % 3 == 1, F.unhex(F.lit("78C379E282"))).otherwise(F.unhex(F.lit("")))
    raw = F.concat(F.col("text").cast("binary"), broken)
    return tables.table(spark, d, "documents").select("doc_id", F.md5(scalars.valid_utf8(raw).cast("binary")).alias("text"))


@query(f"""with {_LINES} select file, pos, 'fleet.filelog' as scope, md5(line) as body, 'log.file.identity=' || file || ';log.file.record_end_offset=' || end_offset || ';log.file.record_offset=' || start_offset || ';log.source.type=file' as attributes
from lines where line <> ''""")
def s4_flatten_otlp_logs(spark: SparkSession, d: str) -> DataFrame:
    """Lines built into log documents (S6), bounded (P8), and read back."""
    rows = _lines(spark, d).where(logs.valid_record("line"))
    none = F.lit(None).cast("string")
    r = {"body": F.col("line"), "source_id": none, "source_type": F.lit("file"), "relative_path": F.col("file"), "file_identity": F.col("file"), "start_offset": F.col("start_offset"), "end_offset": F.col("end_offset"), "observed_us": F.lit(1), "service_name": none, "environment": none, "severity_text": none, "attributes": F.expr("cast(map() as map<string,string>)")}
    built = rows.select("file", "pos", otlp.log_document(r, F.create_map(F.lit("host.name"), F.lit("h"))).alias("payload"))
    flat = otlp.flatten_logs(built)
    held = F.array_join(F.transform(F.array_sort(F.filter(F.map_entries("attributes"), lambda e: ~e["key"].isin("log.file.name", "log.file.path"))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return flat.select("file", "pos", "scope", F.md5(F.col("body").cast("binary")).alias("body"), held.alias("attributes"))


# ---- journal --------------------------------------------------------------------------------------------------------


def journal(spark: SparkSession, d: str) -> DataFrame:
    """host, position, value: conversations as journal entries in JSON."""
    c = tables.table(spark, d, "conversations")
    unit = F.when(F.col("role") == "user", "web.service").when(F.col("role") == "assistant", "db")
    return c.select(
        F.col("conv_id").alias("host"), F.col("turn").alias("position"), F.col("turn").alias("fallback_us"),
        F.to_json(F.struct(F.concat_ws(":", "conv_id", "turn").alias("__CURSOR"), F.col("text").alias("MESSAGE"), (F.col("turn") % 9).cast("string").alias("PRIORITY"), unit.alias("_SYSTEMD_UNIT"), F.when(F.col("turn") % 2 == 0, F.col("conv_id") * 1000).cast("string").alias("__REALTIME_TIMESTAMP"), (F.col("turn") + 1).alias("_PID"))).alias("value"),
    )


_JOURNAL = """j as (select conv_id as host, turn as position, conv_id || ':' || turn as cursor, text as body, (turn % 9)::varchar as priority,
  case role when 'user' then 'web.service' when 'assistant' then 'db' end as unit, case when turn % 2 = 0 and conv_id > 0 then conv_id * 1000 else turn end as observed_us from conversations where text <> '')"""


@query(f"""with {_JOURNAL} select host, position, body, observed_us, coalesce(case unit when 'web.service' then 'web' else unit end, '') as service,
  case when priority in ('0','1','2') then 'FATAL' when priority = '3' then 'ERROR' when priority = '4' then 'WARN' when priority in ('5','6') then 'INFO' when priority = '7' then 'DEBUG' else '' end as severity,
  sha256('{scalars.JOURNAL_TAG}' || chr(0) || 'journald' || chr(0) || cursor) as admission_id from j""")
def h7_parse_journal(spark: SparkSession, d: str) -> DataFrame:
    return logs.parse_journal(journal(spark, d)).where("ok").select("host", "position", "body", "observed_us", "service", "severity", "admission_id")


@query(f"with {_JOURNAL} select host, position from j where unit in ('web.service', 'db') and priority::int <= 4")
def p4_filter_journal(spark: SparkSession, d: str) -> DataFrame:
    parsed = logs.parse_journal(journal(spark, d)).where("ok")
    return logs.filter_journal(parsed, ["web.service", "db"], None, "warning").select("host", "position")


@query(f"""with {_JOURNAL} select host, position from j where case when host % 3 = 0 then position > 1
  when host % 3 = 1 then observed_us >= ((host * 900) // 1000000) * 1000000 else true end""")
def p5_resume_from(spark: SparkSession, d: str) -> DataFrame:
    parsed = logs.parse_journal(journal(spark, d)).where("ok").select("host", "position", "cursor", "observed_us")
    hosts = parsed.select("host").distinct()
    state = hosts.where("host % 3 < 2").select("host", F.when(F.col("host") % 3 == 0, F.concat(F.col("host").cast("string"), F.lit(":1"))).alias("cursor"), (F.col("host") * 900).alias("since_us"))
    return logs.resume_from(parsed, state).select("host", "position")


@query(f"""with {_JOURNAL}, {_LINES} select 'journal' as kind, host::varchar as owner, position::bigint as place, md5(body) as body,
  case when priority in ('0','1','2') then 'FATAL' when priority = '3' then 'ERROR' when priority = '4' then 'WARN' when priority in ('5','6') then 'INFO' when priority = '7' then 'DEBUG' else '' end as severity from j
union all select 'file', file, start_offset, md5(line), null from lines where line <> ''""")
def u2_all_logs(spark: SparkSession, d: str) -> DataFrame:
    body = F.md5(F.col("body").cast("binary")).alias("body")
    file = _lines(spark, d).where(logs.valid_record("line")).select(F.lit("file").alias("kind"), F.col("file").alias("owner"), F.col("start_offset").alias("place"), F.col("line").alias("body"))
    entries = logs.parse_journal(journal(spark, d)).where("ok").select(F.lit("journal").alias("kind"), F.col("host").cast("string").alias("owner"), F.col("position").cast("long").alias("place"), "body", "severity")
    return logs.all_logs(file, entries).select("kind", "owner", "place", body, "severity")


@query("""select user_id as host, event_id, list_transform([event_id % 97, event_id % 89, event_id % 83, 0, 1, 2, 3, 4], lambda x: x / 100.0::double)::varchar as seconds,
case when event_id % 5 <> 0 then (event_id % 1000) * 1000000 end as start_us from events""")
def s9_parse_proc_stat(spark: SparkSession, d: str) -> DataFrame:
    """Events as captures of /proc/stat."""
    e = tables.table(spark, d, "events")
    text = F.concat(F.lit("cpu  "), F.concat_ws(" ", F.col("event_id") % 97, F.col("event_id") % 89, F.col("event_id") % 83, *[F.lit(k) for k in (0, 1, 2, 3, 4, 9, 9)]), F.lit("\ncpu0 1 2 3 4 5 6 7 8\n"), F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("btime "), F.col("event_id") % 1000, F.lit("\n"))).otherwise(""))
    got = files.parse_proc_stat(e.select(F.col("user_id").alias("host"), "event_id", text.alias("text")))
    return got.select("host", "event_id", F.concat(F.lit("["), F.array_join(F.transform("cpu", lambda x: x.cast("string")), ", "), F.lit("]")).alias("seconds"), "start_us")


# ---- identity -------------------------------------------------------------------------------------------------------


def identities(spark: SparkSession, d: str) -> DataFrame:
    """customers as hosts: some with verified instance evidence, some with a machine id, some labelled, some with none."""
    c = tables.table(spark, d, "customer").select("c_custkey", "c_nationkey")
    k = F.col("c_custkey")
    hexed = F.lpad(F.lower(F.hex(k)), 17, "0")
    return c.select(
        k.alias("host"), F.when(k % 4 == 0, F.concat(F.lit(" label-"), k)).otherwise("").alias("configured"),
        F.struct((k % 3 == 0).alias("verified"), F.lit("aws").alias("provider"), F.lit("aws_ec2").alias("platform"), F.when(k % 9 == 0, "hostname").otherwise(F.concat(F.lit("i-"), hexed)).alias("instance_id")).alias("evidence"),
        F.when(k % 5 != 0, F.concat(F.lit("machine-"), k, F.lit("\n"))).alias("machine"),
        F.lpad(k.cast("string"), 12, "0").alias("account"), F.concat(F.lit("eu-west-"), F.col("c_nationkey") % 3 + 1).alias("region"), F.concat(F.lit("i-"), hexed).alias("instance"),
    )


_IDENTITY = """idn as (select c_custkey as host, case when c_custkey % 4 = 0 then 'label-' || c_custkey else '' end as configured, c_custkey % 3 = 0 and c_custkey % 9 <> 0 as cloud,
  'i-' || lpad(printf('%x', c_custkey), 17, '0') as instance, case when c_custkey % 5 <> 0 then 'machine-' || c_custkey else '' end as machine,
  lpad(c_custkey::varchar, 12, '0') as account, 'eu-west-' || (c_nationkey % 3 + 1) as region from customer),
idr as (select *, case when cloud then instance else machine end as host_id, case when configured <> '' then configured when cloud then instance else machine end as agent_id from idn)"""


@query(f"with {_IDENTITY} select host, nullif(agent_id, '') as agent_id, case when agent_id <> '' then host_id end as host_id, case when agent_id = '' then 'no_identity' end as error from idr")
def h9_resolve_identity(spark: SparkSession, d: str) -> DataFrame:
    return identities(spark, d).select("host", scalars.resolve_identity(F.col("configured"), F.col("evidence"), F.col("machine")).alias("r")).select("host", "r.agent_id", "r.host_id", "r.error")


@query(f"""with {_IDENTITY} select host, case when host % 7 = 0 then null else account end as account, case when host % 7 = 0 then null else 'arn:aws:ec2:' || region || ':' || account || ':instance/' || instance end as arn from idr""")
def h10_parse_instance_document(spark: SparkSession, d: str) -> DataFrame:
    i = identities(spark, d)
    text = F.to_json(F.struct(F.col("account").alias("accountId"), "region", F.concat("region", F.lit("a")).alias("availabilityZone"), F.when(F.col("host") % 7 == 0, "hostname").otherwise(F.col("instance")).alias("instanceId"), F.lit("m5.large").alias("instanceType")))
    return i.select("host", scalars.instance_document(text).alias("x")).select("host", "x.account", "x.arn")


@query("select c_custkey as host, c_custkey % 3 <> 0 as ok from customer")
def h11_valid_machine_id(spark: SparkSession, d: str) -> DataFrame:
    c = tables.table(spark, d, "customer")
    text = F.concat(F.lit(" "), F.when(F.col("c_custkey") % 3 == 0, F.upper(F.md5(F.lit(b"abc")))).otherwise(F.md5(F.col("c_custkey").cast("string").cast("binary"))), F.lit("\n"))
    return c.select(F.col("c_custkey").alias("host"), scalars.valid_machine_id(text).alias("ok"))


def _scopes(spark: SparkSession, d: str, tag: str) -> DataFrame:
    i = identities(spark, d)
    return i.select("host", scalars.scope_hash(F.lit("b<1>"), F.when(F.col("host") % 11 != 0, "org").otherwise(" "), F.col("host"), F.col("account"), F.col("region"), tag).alias("scope"))


@query(f"""with {_IDENTITY} select host, case when host % 11 <> 0 then sha256('{scalars.METRICS_SCOPE_TAG}' || chr(0) || '["b\\u003c1\\u003e","org","' || host || '","' || account || '","' || region || '"]') end as scope from idr""")
def h2_scope_hash(spark: SparkSession, d: str) -> DataFrame:
    return _scopes(spark, d, scalars.METRICS_SCOPE_TAG)


@query("select event_id, 'app.' || replace(event_type || '.' || 'count', '.', '_') as metric_id from events")
def h13_metric_id(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "events").select("event_id", scalars.metric_id(F.concat("event_type", F.lit(".count"))).alias("metric_id"))


_ENTITIES = f"""{_IDENTITY}, ents as (select 'e' || host as id, host, case when host % 2 = 0 then 'aws:' || account || ':' || region || ':ec2:' || instance else 'host:' || host end as canonical_key,
  case host % 4 when 0 then 'host' when 1 then 'aws_ec2_instance' when 2 then 'service' else 'other' end as entity_type from idr)"""


def entities(spark: SparkSession, d: str) -> DataFrame:
    i = identities(spark, d)
    even = F.col("host") % 2 == 0
    none = F.lit(None).cast("string")
    return i.select(F.concat(F.lit("e"), "host").alias("id"), "host", scalars.canonical_key(F.when(even, F.col("account")), F.col("region"), F.col("instance"), F.col("host").cast("string")).alias("canonical_key"), F.element_at(F.array(F.lit("host"), F.lit("aws_ec2_instance"), F.lit("service"), F.lit("other")), (F.col("host") % 4 + 1).cast("int")).alias("entity_type")).withColumn("display_name", none)


@query(f"with {_ENTITIES} select id, canonical_key from ents")
def h12_canonical_key(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d).select("id", "canonical_key")


@query(f"with {_IDENTITY} select o_orderkey, 'host.arch=x;host.name=' || agent_id || case when host_id <> '' then ';host.id=' || host_id else '' end as resource from orders left join idr on host = o_custkey")
def j1_enrich_resource(spark: SparkSession, d: str) -> DataFrame:
    i = identities(spark, d).select("host", scalars.resolve_identity(F.col("configured"), F.col("evidence"), F.col("machine")).alias("r"))
    agent, host = F.coalesce("r.agent_id", F.lit("")), F.coalesce("r.host_id", F.lit(""))
    held = i.select("host", identity.resource(agent, host, F.lit("linux"), F.lit("x"), F.lit("1"), F.lit(""), {}).alias("resource"))
    o = tables.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("host"))
    r = F.col("resource")
    return identity.enrich(o, held).select("o_orderkey", F.concat(F.lit("host.arch="), r["host.arch"], F.lit(";host.name="), r["host.name"], F.when(r["host.id"].isNotNull(), F.concat(F.lit(";host.id="), r["host.id"])).otherwise("")).alias("resource"))


@query(f"with {_ENTITIES}, o as (select o_orderkey, case when o_orderkey % 3 <> 0 then 'host:' || o_custkey end as k from orders) select o_orderkey, id as entity_id from o left join ents on canonical_key = k")
def j2_correlate_entities(spark: SparkSession, d: str) -> DataFrame:
    o = tables.table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("host:"), "o_custkey")).alias("canonical_key"))
    return identity.correlate(o, entities(spark, d)).select("o_orderkey", "entity_id")


# ---- spool ----------------------------------------------------------------------------------------------------------

_SPOOL = """spool as (select o_custkey::varchar as scope, o_orderkey as seq, '{"k":' || o_orderkey || '}' as payload, sha256(case when o_orderkey % 10 = 0 then 'a' else o_orderkey::varchar end) as admission_id,
  o_orderkey % 53 <> 0 as ok, 100 + o_orderkey % 9000 as envelope_bytes from orders)"""


def spool(spark: SparkSession, d: str) -> DataFrame:
    o, k = tables.table(spark, d, "orders"), F.col("o_orderkey")
    payload = F.to_json(F.struct(k.alias("k")))
    rows = o.select(F.col("o_custkey").cast("string").alias("scope"), k.alias("seq"), F.lit(1).alias("version"), payload.alias("payload"), F.sha2(F.when(k % 10 == 0, "a").otherwise(k.cast("string")).cast("binary"), 256).alias("admission_id"), (100 + k % 9000).alias("envelope_bytes"))
    return rows.withColumn("hash", F.when(F.col("seq") % 53 == 0, "0").otherwise(F.sha2(F.col("payload").cast("binary"), 256)))


@query(f"with {_SPOOL} select scope, seq, ok from spool")
def h18_verify_record(spark: SparkSession, d: str) -> DataFrame:
    return spool(spark, d).select("scope", "seq", scalars.verify_record(F.col("version"), F.col("payload"), F.col("hash"), F.col("admission_id")).alias("ok"))


@query("select l_orderkey, l_linenumber, l_partkey, ((l_partkey + 4095) // 4096) * 4096 as charged from lineitem")
def h17_charge(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", scalars.charge(F.col("l_partkey")).alias("charged"))


@query("""select o_orderkey, '{"a":' || o_orderkey || ',"b":" x "}' as payload from orders""")
def h19_compact_json(spark: SparkSession, d: str) -> DataFrame:
    o = tables.table(spark, d, "orders")
    return o.select("o_orderkey", scalars.compact_json(F.concat(F.lit('{ "a" : '), F.col("o_orderkey").cast("string"), F.lit(',\n "b": " x " }'))).alias("payload"))


@query(f"with {_SPOOL} select scope, admission_id, count(*) as n from spool group by all having count(*) > 1")
def a1_admission_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return admission.admission_duplicates(spool(spark, d))


@query(f"with {_SPOOL} select scope, min(seq) as seq, admission_id from spool where seq % 2 = 0 and (scope, admission_id) not in (select scope, admission_id from spool where seq % 2 = 1 and seq % 3 = 0) group by scope, admission_id")
def j3_idempotent_admission(spark: SparkSession, d: str) -> DataFrame:
    s = spool(spark, d)
    return admission.admit(s.where("seq % 2 = 0"), s.where("seq % 2 = 1 and seq % 3 = 0"), "seq").select("scope", "seq", "admission_id")


@query(ORACLES["j3_idempotent_admission"])
def j3_admission_to_a_table(spark: SparkSession, d: str) -> DataFrame:
    """The same against a spool table that is bucketed by scope and admission id."""
    s = spool(spark, d)
    path = tables.shared_folder(spark, "spool-table")
    name = f"spool_{path.rsplit('-', 1)[1]}"
    files.write_spool_table(s.where("seq % 2 = 1 and seq % 3 = 0"), name, path, 16)
    return admission.admit_to_table(s.where("seq % 2 = 0"), name, 16, "seq").select("scope", "seq", "admission_id")


@query(f"with {_SPOOL} select scope, seq from spool where seq % 4 <> 1")
def j4_backlog(spark: SparkSession, d: str) -> DataFrame:
    s = spool(spark, d)
    return admission.backlog(s, s.where("seq % 4 = 1")).select("scope", "seq")


@query(f"with {_SPOOL} select scope, seq from spool where admission_id in (select admission_id from spool where seq % 6 = 0)")
def j5_activate_ready(spark: SparkSession, d: str) -> DataFrame:
    s = spool(spark, d)
    return admission.activate(s, s.where("seq % 6 = 0")).select("scope", "seq")


@query(f"""with {_IDENTITY}, s as (select *, 1 + host % 2 as layout from idr) select host, case when host % 11 = 0 then 'identity_required' when layout = 2 and host % 6 <> 1 then 'ok' when layout = 2 then 'v2_mismatch' when host % 6 <> 2 then 'v1_migratable' else 'v1_unverified' end as status from s""")
def j6_scope_binding_audit(spark: SparkSession, d: str) -> DataFrame:
    legacy = identities(spark, d).select("host", scalars.legacy_scope_hash(F.lit("https://e"), F.col("host"), F.col("account"), F.col("region")).alias("legacy"))
    known = _scopes(spark, d, scalars.METRICS_SCOPE_TAG).join(legacy, "host")
    stored = F.when(F.col("host") % 2 == 1, F.when(F.col("host") % 6 == 1, "x").otherwise(F.col("scope"))).otherwise(F.when(F.col("host") % 6 == 2, "x").otherwise(F.col("legacy")))
    spools = known.select("host", (F.lit(1) + F.col("host") % 2).alias("layout"), stored.alias("stored"))
    return admission.scope_binding(spools, known).select("host", "status")


@query(f"with {_SPOOL} select scope, seq, row_number() over (partition by scope order by seq)::int as place from spool where seq % 4 <> 1")
def w11_fifo_backlog(spark: SparkSession, d: str) -> DataFrame:
    s = spool(spark, d)
    return admission.fifo(admission.backlog(s, s.where("seq % 4 = 1"))).select("scope", "seq", "place")


@query(f"""with recursive {_SPOOL}, o as (select scope, seq, ((envelope_bytes + 4095) // 4096) * 4096 as cost, row_number() over (partition by scope order by seq) as n from spool),
f as (select scope, seq, n, 28672 + cost <= 60000 as admitted, case when 28672 + cost <= 60000 then 28672 + cost else 28672 end as used, case when 28672 + cost <= 60000 then 1 else 0 end as items from o where n = 1
union all select o.scope, o.seq, o.n, f.items < 40 and f.used + o.cost <= 60000, case when f.items < 40 and f.used + o.cost <= 60000 then f.used + o.cost else f.used end, case when f.items < 40 and f.used + o.cost <= 60000 then f.items + 1 else f.items end
from f join o on o.scope = f.scope and o.n = f.n + 1)
select scope, seq, admitted from f""")
def w12_quota_admission(spark: SparkSession, d: str) -> DataFrame:
    s = spool(spark, d).select("scope", F.col("seq").alias("at"), "seq", F.lit("put").alias("event"), "envelope_bytes")
    return admission.quota_admission(s, 40, 60000)


@query(f"""with {_SPOOL} select scope, count(*) as records, sum(case when ok then 0 else 1 end)::bigint as corrupt, (sum(((envelope_bytes + 4095) // 4096) * 4096) + 28672)::bigint as charged,
  sum(((envelope_bytes + 4095) // 4096) * 4096) + 28672 > 60000 or count(*) > 40 as over from spool group by scope""")
def a12_spool_usage(spark: SparkSession, d: str) -> DataFrame:
    s = spool(spark, d).withColumn("ok", scalars.verify_record(F.col("version"), F.col("payload"), F.col("hash")))
    return admission.spool_usage(s, 40, 60000)


@query("""with o as (select o_custkey::varchar as scope, o_orderkey, o_orderkey % 2 as half, '{"o_orderkey":' || o_orderkey || '}' as payload from orders),
n as (select *, row_number() over (partition by scope order by half, o_orderkey) as seq from o)
select scope, o_orderkey, seq::bigint as seq, lpad(seq::varchar, 20, '0') as name, payload, sha256(payload) as hash, 1 as version from n""")
def s7_spool(spark: SparkSession, d: str) -> DataFrame:
    """Records spooled in two runs, the second going on from what the first has written, and read back."""
    o = tables.table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("scope"), F.col("o_orderkey"), F.to_json(F.struct("o_orderkey")).alias("payload"))
    path = tables.shared_folder(spark, "spool")
    files.write_spool(files.spooled(o.where("o_orderkey % 2 = 0"), None, "o_orderkey"), path)
    first = files.read_spool(spark, path)
    files.write_spool(files.spooled(o.where("o_orderkey % 2 = 1"), first, "o_orderkey"), path)
    return files.read_spool(spark, path).select("scope", "o_orderkey", "seq", "name", "payload", "hash", "version")


# ---- delivery -------------------------------------------------------------------------------------------------------

_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"
_ATTEMPTS = f"""att as (select o_custkey as host, l_orderkey as batch_id, case when l_orderkey % 2 = 0 then 'logs' else 'metrics' end as signal, row_number() over (partition by l_orderkey order by {_ORDER}) as attempt,
  case when l_partkey % 29 = 0 then 'timeout' when l_partkey % 31 = 0 then 'tls' end as error, case l_partkey % 10 when 0 then 200 when 1 then 429 when 2 then 503 when 3 then 501 when 4 then 401 when 5 then 200 when 6 then 500 when 7 then 429 when 8 then 204 else 422 end as status,
  l_partkey % 10 as p, l_suppkey % 4 as q from lineitem join orders on o_orderkey = l_orderkey),
cls as (select *, case when error is null and p = 5 and q = 1 then 2 else 0 end as rejected, case when error = 'tls' then 'rejected' when error is not null then 'retry' when status = 401 then 'unauthorized'
  when status between 200 and 299 then case when p = 5 and q = 1 and signal = 'metrics' then 'rejected' when p = 5 and q = 2 then 'rejected' else 'accepted' end
  when status = 429 or (status >= 500 and status <> 501) then 'retry' else 'rejected' end as outcome from att)"""


def attempts(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders as delivery attempts of a batch each."""
    from pyspark.sql import Window

    li = tables.table(spark, d, "lineitem").join(tables.table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    p, q = F.col("l_partkey") % 10, F.col("l_suppkey") % 4
    codes = F.array(*map(F.lit, (200, 429, 503, 501, 401, 200, 500, 429, 204, 422)))
    body = F.when(p != 5, "").when(q == 0, '{"data":{"partialSuccess":{"rejectedDataPoints":"0"}}}').when(q == 1, '{"partialSuccess":{"rejectedDataPoints":"2","rejectedLogRecords":2}}').when(q == 2, "not-json").otherwise(" {} ")
    return li.select(
        F.col("o_custkey").alias("host"), F.col("l_orderkey").alias("batch_id"), F.when(F.col("l_orderkey") % 2 == 0, "logs").otherwise("metrics").alias("signal"),
        F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER.split(", "))).alias("attempt"),
        F.when(F.col("l_partkey") % 29 == 0, "timeout").when(F.col("l_partkey") % 31 == 0, "tls").alias("error"), F.element_at(codes, (p + 1).cast("int")).alias("status"), body.alias("body"),
    )


@query(f"with {_ATTEMPTS} select batch_id, attempt::int as attempt, outcome from cls")
def h14_classify_attempt(spark: SparkSession, d: str) -> DataFrame:
    return delivery.classified(attempts(spark, d)).select("batch_id", "attempt", "outcome")


@query(f"with {_ATTEMPTS} select batch_id, attempt::int as attempt, rejected::bigint as rejected from cls where error is null and status between 200 and 299")
def h15_partial_success(spark: SparkSession, d: str) -> DataFrame:
    a = attempts(spark, d).where("error is null and status between 200 and 299")
    return a.select("batch_id", "attempt", scalars.partial_success(F.col("signal"), F.col("body"))["rejected"].alias("rejected"))


@query("""select event_id, case when event_id % 2 = 0 then least(delay, 1800) else delay end as delay from (select event_id, case event_id % 3 when 0 then (event_id % 4000)::double when 1 then 3600.0::double else least(pow(2, event_id % 8), 30) end as delay from events)""")
def h16_retry_delay(spark: SparkSession, d: str) -> DataFrame:
    e, k = tables.table(spark, d, "events"), F.col("event_id")
    header = F.when(k % 3 == 0, (k % 4000).cast("string")).when(k % 3 == 1, "Mon, 01 Jan 2024 01:00:00 GMT").otherwise("soon")
    now = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    return e.select("event_id", scalars.retry_delay(F.when(k % 2 == 0, "logs").otherwise("metrics"), header, k % 8, now).alias("delay"))


_OUTCOMES = """used as (select * from cls where attempt <= 4), fin as (select batch_id, min(attempt) as n, arg_min(outcome, attempt) as outcome, arg_min(rejected, attempt) as rejected from used where outcome <> 'retry' group by 1),
outc as (select u.host, u.signal, u.batch_id, coalesce(any_value(f.outcome), case when max(u.attempt) = 4 then 'exhausted' else 'pending' end) as outcome, coalesce(any_value(f.n), max(u.attempt))::int as attempts, coalesce(any_value(f.rejected), 0)::bigint as rejected
  from used u left join fin f using (batch_id) group by all)"""


@query(f"with {_ATTEMPTS}, {_OUTCOMES} select host, signal, batch_id, outcome, attempts, (attempts - 1)::int as retries, rejected from outc")
def w8_delivery_outcome(spark: SparkSession, d: str) -> DataFrame:
    return delivery.batch_outcomes(delivery.classified(attempts(spark, d)))


# ---- policies -------------------------------------------------------------------------------------------------------

_CAPS = ("metrics", "logs", "traces", "processes")


def envelopes(spark: SparkSession, d: str) -> DataFrame:
    """Orders as policies of their customer's installation."""
    o, k = tables.table(spark, d, "orders"), F.col("o_orderkey")
    enabled = F.create_map(*[x for i, c in enumerate(_CAPS) for x in (F.lit(c), F.floor(k / (2**i)) % 2 == 0)], F.when(k % 37 == 0, "mystery").otherwise("discovery"), F.lit(False))
    return o.select(
        F.col("o_custkey").alias("installation"), k.alias("arrival"), (k % 70000).cast("int").alias("raw_bytes"), (k % 19 != 0).alias("verified"), F.lit("org").alias("organization_id"), F.when(k % 23 == 0, "other").otherwise(F.col("o_custkey").cast("string")).alias("installation_id"),
        (k % 100).alias("expires_us"), F.lit(3).alias("now_us"), (k % 41).alias("version"), enabled.alias("enabled"), (k % 2).alias("content"),
    )


@query("""with e as (select *, o_orderkey as k, o_orderkey % 70000 as raw from orders)
select o_custkey as installation, k as arrival, case when raw = 0 or raw > 65536 then 'unavailable' when k % 19 = 0 then 'authentication' when k % 23 = 0 then 'scope' when k % 100 <= 3 then 'expired' when k % 41 = 0 then 'version' when k % 37 = 0 then 'unknown_capability'
  when (k // 4) % 2 = 0 or (k // 8) % 2 = 0 then 'exceeds_allowance' end as reason from e""")
def j7_policy_gate(spark: SparkSession, d: str) -> DataFrame:
    e = envelopes(spark, d)
    pins = tables.table(spark, d, "customer").select(F.col("c_custkey").alias("installation"), F.lit("org").alias("pin_organization"), F.col("c_custkey").cast("string").alias("pin_installation"), F.array(F.lit("metrics"), F.lit("logs")).alias("allowed"))
    return policy.policy_gate(e, pins).select("installation", "arrival", "reason")


_DECIDED = """pol as (select o_custkey as installation, o_orderkey as arrival, o_orderkey % 41 as version, o_orderkey % 2 as content from orders),
dec as (select *, max(version) over (partition by installation order by arrival rows between unbounded preceding and 1 preceding) as m, first_value(content) over (partition by installation, version order by arrival) as c from pol),
decided as (select *, case when m is null or version > m then 'accept' when version = m and content = c then 'noop' else 'reject' end as decision from dec)"""


@query(f"with {_DECIDED} select installation, arrival, version, decision from decided")
def w6_accept_policies(spark: SparkSession, d: str) -> DataFrame:
    return policy.accept_policies(envelopes(spark, d)).select("installation", "arrival", "version", "decision")


_ENABLED = "list_sort(list_filter(['logs', 'metrics', 'processes', 'traces'], lambda c: case c when 'metrics' then arrival % 2 = 0 when 'logs' then (arrival // 2) % 2 = 0 when 'traces' then (arrival // 4) % 2 = 0 else (arrival // 8) % 2 = 0 end))"


@query(f"""with {_DECIDED}, a as (select installation, arrival, {_ENABLED} as e from decided where decision = 'accept'), b as (select *, coalesce(lag(e) over (partition by installation order by arrival), []) as o from a)
select installation, arrival, array_to_string(list_filter(o, lambda x: not list_contains(e, x)), ',') as stop, array_to_string(list_filter(e, lambda x: not list_contains(o, x)), ',') as start, array_to_string(list_filter(o, lambda x: list_contains(e, x)), ',') as keep from b""")
def w7_policy_transitions(spark: SparkSession, d: str) -> DataFrame:
    accepted = policy.accept_policies(envelopes(spark, d)).where("decision = 'accept'").select("installation", "arrival", F.map_keys(F.map_filter("enabled", lambda k, v: v)).alias("enabled"))
    moved = policy.policy_transitions(accepted)
    return moved.select("installation", "arrival", *[F.array_join(c, ",").alias(c) for c in ("stop", "start", "keep")])


# ---- evidence -------------------------------------------------------------------------------------------------------

_SAMPLES = """base as (select event_id, 'org' || (user_id % 3) as organization_id, 'e' || user_id as entity_id, 'app.' || event_type as metric_id, 'avg' as statistic, 's' || (event_id % 2) as source_id, case when event_id % 2 = 0 then 'agent' else 'cloud' end as source_type,
  'aws' as provider, 'ns' || (event_id % 5) as metric_namespace, event_type as metric_name, (epoch_us(ts) // 3600000000) * 3600000000 as observed_us, epoch_us(ts) as ingested_us, value, (event_id % 7)::varchar as v from events),
samples as (select * from base union all select * replace (ingested_us + 5 as ingested_us, value + 1 as value) from base where event_id % 6 = 0)"""


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Events as stored samples by the hour, some ingested twice."""
    e, k = tables.table(spark, d, "events"), F.col("event_id")
    us = tables.micros()
    base = e.select(
        "event_id", F.concat(F.lit("org"), F.col("user_id") % 3).alias("organization_id"), F.concat(F.lit("e"), "user_id").alias("entity_id"), F.concat(F.lit("app."), "event_type").alias("metric_id"), F.lit("avg").alias("statistic"), F.concat(F.lit("s"), k % 2).alias("source_id"),
        F.when(k % 2 == 0, "agent").otherwise("cloud").alias("source_type"), F.lit("aws").alias("provider"), F.concat(F.lit("ns"), k % 5).alias("metric_namespace"), F.col("event_type").alias("metric_name"),
        (us - F.pmod(us, F.lit(3_600_000_000))).alias("observed_us"), us.alias("ingested_us"), "value", F.create_map(F.lit("version"), (k % 7).cast("string")).alias("dimensions"),
    )
    again = base.where("event_id % 6 = 0").withColumn("ingested_us", F.col("ingested_us") + 5).withColumn("value", F.col("value") + 1)
    return base.unionByName(again)


_KEY = ", ".join(evidence.KEY)


@query(f"with {_SAMPLES} select {_KEY}, ingested_us, value from samples qualify row_number() over (partition by {_KEY} order by ingested_us desc, value desc) = 1")
def w9_latest_version(spark: SparkSession, d: str) -> DataFrame:
    return evidence.latest_version(samples(spark, d)).select(*evidence.KEY, "ingested_us", "value")


@query(f"with {_SAMPLES}, l as (select * from samples qualify row_number() over (partition by {_KEY} order by ingested_us desc, value desc) = 1) select entity_id, source_type, metric_namespace, count(*) as points, min(observed_us) as first_us, max(observed_us) as latest_us from l group by all")
def a7_mapping_coverage(spark: SparkSession, d: str) -> DataFrame:
    return evidence.mapping_coverage(evidence.latest_version(samples(spark, d)))


@query(f"with {_SAMPLES} select source_type, provider, metric_namespace, metric_name, count(*) as points, max(observed_us) as newest_us from samples where entity_id = 'e7' group by all")
def a8_provenance(spark: SparkSession, d: str) -> DataFrame:
    return evidence.provenance(samples(spark, d), "e7")


@query(f"with {_SAMPLES} select count(*) as physical, count(distinct ({_KEY})) as logical from samples")
def a9_duplicate_ratio(spark: SparkSession, d: str) -> DataFrame:
    return evidence.duplicate_ratio(samples(spark, d))


@query(f"with {_SAMPLES} select source_type, count(*) as n from samples where entity_id = 'e3' group by all")
def a10_source_counts(spark: SparkSession, d: str) -> DataFrame:
    return evidence.counts(samples(spark, d).where("entity_id = 'e3'"), "source_type")


@query(f"with {_ENTITIES} select entity_type, count(*) as n from ents where entity_type in ('host', 'aws_ec2_instance', 'service') group by all")
def a11_entity_counts(spark: SparkSession, d: str) -> DataFrame:
    return evidence.counts(entities(spark, d), "entity_type", ["host", "aws_ec2_instance", "service"])


@query(f"with {_SAMPLES} select entity_id, metric_id, observed_us, value from samples where observed_us >= 1704067200000000 + 86400000000 and observed_us < 1704067200000000 + 5 * 86400000000 and organization_id = 'org1' and v = '3'")
def p11_samples_window(spark: SparkSession, d: str) -> DataFrame:
    day, first = 86_400_000_000, 1_704_067_200_000_000
    return evidence.samples_window(samples(spark, d), first + day, first + 5 * day, "org1", ("version", "3")).select("entity_id", "metric_id", "observed_us", "value")


@query("select o_orderkey as id from orders where o_custkey % 50 = 0 or (o_orderkey % 997) % 50 = 0")
def p12_relationships_of(spark: SparkSession, d: str) -> DataFrame:
    edges = tables.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("source_entity_id"), (F.col("o_orderkey") % 997).alias("target_entity_id"))
    both = edges.select(F.col("source_entity_id").alias("entity_id")).union(edges.select("target_entity_id")).where("entity_id % 50 = 0")
    return evidence.relationships_of(edges, both).select("id")


@query("select doc_id, case when contains(text, 'token = ') then 'token = ' when contains(text, 'Apache License') then 'Apache License' end as marker from documents where contains(text, 'token = ') or contains(text, 'Apache License')")
def p13_secret_leak_scan(spark: SparkSession, d: str) -> DataFrame:
    return evidence.leaks(tables.table(spark, d, "documents"), ["token = ", "Apache License"], "text").select("doc_id", "marker")


@query("""with m as (select distinct text[1:12] as marker from documents where strlen(text) > 11 union select 'token = ' union select '(c)')
select doc_id, marker from documents join m on contains(text, marker)""")
def p13_leaks_of_a_table(spark: SparkSession, d: str) -> DataFrame:
    """All texts against a table of markers: the first twelve characters of each of them, and two short ones."""
    docs = tables.table(spark, d, "documents")
    markers = docs.where("octet_length(text) > 11").select(F.substring("text", 1, 12).alias("marker")).union(spark.createDataFrame([("token = ",), ("(c)",)], "marker string"))
    return evidence.leaks_of(docs, markers, "doc_id", "text")


@query("""with p as (select doc_id, case when doc_id % 11 = 0 then '{"text":"' || hex(encode(text)) else case when doc_id % 17 = 0 then '' else '{"text":"' || hex(encode(text)) || '"}' end end as payload from documents)
select doc_id, case when payload = '' then 'empty' when strlen(payload) > 4000 then 'too_large' when not json_valid(payload) then 'invalid' end as reason from p""")
def p10_reject_oversize_payload(spark: SparkSession, d: str) -> DataFrame:
    """Payloads of all texts, some of them broken, empty or too large."""
    whole = F.concat(F.lit('{"text":"'), F.hex(F.col("text").cast("binary")))
    payload = F.when(F.col("doc_id") % 11 == 0, whole).when(F.col("doc_id") % 17 == 0, "").otherwise(F.concat(whole, F.lit('"}')))
    kept, out = logs.reject_payloads(tables.table(spark, d, "documents").select("doc_id", payload.alias("payload")), "payload", 4000)
    return kept.select("doc_id", F.lit(None).cast("string").alias("reason")).union(out.select("doc_id", "reason"))


@query(f"with {_SAMPLES} select metric_namespace, count(*)::bigint as n, true as entities_near, true as metrics_near from samples where observed_us // 86400000000 >= 19724 group by all")
def a6_distinct_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Different entities and metrics of each namespace from sketches per day, held against the exact numbers and the stated error."""
    rows = samples(spark, d)
    day = F.expr("observed_us div 86400000000")
    sketches = evidence.distinct_sketches(rows, ["metric_namespace"], day, entities=F.col("entity_id"), metrics=F.col("metric_id"))
    found = evidence.merged_distinct(sketches, ["metric_namespace"], ["entities", "metrics"], start=19724)
    exact = rows.where(day >= 19724).groupBy("metric_namespace").agg(F.count_distinct("entity_id").alias("e"), F.count_distinct("metric_id").alias("m"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.ceil(F.col(b) * evidence.SKETCH_ERROR)
    return found.join(exact, found.metric_namespace.eqNullSafe(exact.metric_namespace)).select(found.metric_namespace, "n", near("entities", "e").alias("entities_near"), near("metrics", "m").alias("metrics_near"))


@query(f"with {_SAMPLES} select entity_id, metric_id, observed_us, ingested_us from samples order by observed_us desc, entity_id, metric_id, ingested_us limit 200")
def t5_latest_samples(spark: SparkSession, d: str) -> DataFrame:
    return evidence.latest_samples(samples(spark, d)).select("entity_id", "metric_id", "observed_us", "ingested_us")


@query("""select coalesce(b.k, a.k) as id, case when b.k is null then 'added' when a.k is null then 'removed' when b.v = a.v then 'same' else 'changed' end as status
from (select o_orderkey as k, o_custkey as v from orders where o_orderkey % 5 <> 0) b full join (select o_orderkey as k, o_custkey + case when o_orderkey % 7 = 0 then 1 else 0 end as v from orders where o_orderkey % 3 <> 0) a on b.k = a.k""")
def j8_snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    o = tables.table(spark, d, "orders")
    before = o.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("v"))
    after = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") + F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0)).alias("v"))
    return evidence.snapshot_diff(before, after)


# ---- small ones, and round trips through files ----------------------------------------------------------------------


@query("select event_id, case when event_id % 9 in (0, 1, 2) then 'FATAL' when event_id % 9 = 3 then 'ERROR' when event_id % 9 = 4 then 'WARN' when event_id % 9 in (5, 6) then 'INFO' when event_id % 9 = 7 then 'DEBUG' else '' end as severity from events")
def h8_severity(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "events").select("event_id", scalars.severity((F.col("event_id") % 9).cast("string")).alias("severity"))


@query(r"select doc_id, md5(case doc_id % 4 when 0 then text when 1 then text when 2 then text when 3 then text || chr(13) end) as line from documents where not ends_with(text, chr(10)) and not ends_with(text, chr(13))")
def h6_strip_eol(spark: SparkSession, d: str) -> DataFrame:
    """Texts with no, a plain, a Windows and a doubled line end; of the last, one carriage return stays."""
    t = tables.table(spark, d, "documents").where(~F.col("text").rlike("[\r\n]\\z"))
    ends = F.element_at(F.array(*map(F.lit, ("", "\n", "\r\n", "\r\r\n"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return t.select("doc_id", F.md5(scalars.strip_eol(F.concat("text", ends)).cast("binary")).alias("line"))


@query("select o_custkey, o_orderkey from (select o_custkey, o_orderkey from orders where o_orderkey % 2 = 0 except all select o_custkey, o_orderkey from orders where o_orderkey % 3 = 0)")
def u3_capability_sets(spark: SparkSession, d: str) -> DataFrame:
    o = tables.table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return o.where("o_orderkey % 2 = 0").exceptAll(o.where("o_orderkey % 3 = 0"))


@query("select doc_id, text <> '' and strlen(text) <= 1048576 as kept from documents")
def p8_reject_records(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "documents").select("doc_id", logs.valid_record("text").alias("kept"))


@query(f"with {_JOURNAL} select cursor, body from j")
def s2_read_journal_export(spark: SparkSession, d: str) -> DataFrame:
    """The journal written as lines of JSON, read and parsed."""
    path = tables.shared_folder(spark, "journal")
    journal(spark, d).select("value").write.text(path)
    lines, _ = files.read_journal_export(spark, path)
    return logs.parse_journal(lines.withColumn("fallback_us", F.lit(0).cast("long"))).where("ok").select("cursor", "body")


@query(f"with {_SAMPLES} select entity_id, metric_id, observed_us, value from samples where observed_us >= 1704067200000000 + 3 * 86400000000 and observed_us < 1704067200000000 + 4 * 86400000000")
def s8_samples(spark: SparkSession, d: str) -> DataFrame:
    """The fact table written by day, and one day read back."""
    import datetime

    path = tables.shared_folder(spark, "samples")
    files.write_samples(samples(spark, d).withColumn("observed_at", F.timestamp_micros("observed_us")), path)
    day = datetime.datetime(2024, 1, 4, tzinfo=datetime.UTC)
    return files.read_samples(spark, path, day, day + datetime.timedelta(days=1)).select("entity_id", "metric_id", "observed_us", "value")
