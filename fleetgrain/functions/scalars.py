"""Column functions: ids and hashes, identity documents, outcomes of delivery attempts.

Bounds on text are in bytes. Patterns end in \\z, as $ also matches before a last newline.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Severities by priority, patterns of identities, bounds and the charge unit.
SEVERITIES = {"0": "FATAL", "1": "FATAL", "2": "FATAL", "3": "ERROR", "4": "WARN", "5": "INFO", "6": "INFO", "7": "DEBUG"}
PRIORITIES = ("emerg", "alert", "crit", "err", "warning", "notice", "info", "debug")
INSTANCE = r"^i-([0-9a-f]{8}|[0-9a-f]{17})\z"
MACHINE = r"^[0-9a-f]{32}\z"
REGION = r"^[a-z]{2}(-[a-z0-9]+)+-[0-9]+\z"
ACCOUNT = r"^[0-9]{12}\z"
CHARGE_UNIT = 4096
FINGERPRINT_BYTES = 256
MAX_SCOPE_BYTES = 256
MAX_RESPONSE = 65536

#: Domain tags of the ids made here.
FILE_TAG, JOURNAL_TAG, METRICS_SCOPE_TAG, LOGS_SCOPE_TAG = "fleet-log-admission-v1", "fleet-journal-admission-v1", "fleet-metrics-scope-v2", "fleet-logs-scope-v2"


def _nul_joined(*parts: Column) -> Column:
    return F.concat_ws("\x00", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def file_admission_id(source: Column, identity: Column, generation: Column, start: Column, end: Column, tag: str = FILE_TAG) -> Column:
    return F.sha2(_nul_joined(F.lit(tag), source, identity, generation, start, end).cast("binary"), 256)


def journal_admission_id(source: Column, cursor: Column, tag: str = JOURNAL_TAG) -> Column:
    return F.sha2(_nul_joined(F.lit(tag), source, cursor).cast("binary"), 256)


def scope_hash(backend: Column, organization: Column, host: Column, account: Column, region: Column, tag: str = METRICS_SCOPE_TAG) -> Column:
    """Hash of five values as a JSON array whose <, > and & are escaped; null if one is too long, has NUL, CR or LF, or one of the first three is blank."""
    values = [F.coalesce(v.cast("string"), F.lit("")) for v in (backend, organization, host, account, region)]
    text = F.to_json(F.array(*values))
    for sign in "<>&  ":
        text = F.replace(text, F.lit(sign), F.lit(f"\\u{ord(sign):04x}"))
    bad = F.lit(False)
    for i, v in enumerate(values):
        bad = bad | (F.octet_length(v) > MAX_SCOPE_BYTES) | v.rlike("[\x00\r\n]")
        if i < 3:
            bad = bad | (F.trim(v) == "")
    return F.when(~bad, F.sha2(F.concat(F.lit(tag), F.lit("\x00"), text).cast("binary"), 256))


def legacy_scope_hash(endpoint: Column, host: Column, account: Column, region: Column) -> Column:
    return F.sha2(_nul_joined(endpoint, host, account, region).cast("binary"), 256)


def fingerprint(content: Column) -> Column:
    return F.sha2(F.substring(content.cast("binary"), 1, FINGERPRINT_BYTES), 256)


def file_identity(dev: Column, ino: Column) -> Column:
    return F.concat(F.lower(F.hex(dev)), F.lit(":"), F.lower(F.hex(ino)))


def charge(n: Column, unit: int = CHARGE_UNIT) -> Column:
    n = n.cast("long")
    return n + F.pmod(-n, F.lit(unit))


def severity(priority: Column) -> Column:
    out = F.lit("")
    for code, name in SEVERITIES.items():
        out = F.when(priority == code, name).otherwise(out)
    return out


def strip_eol(line: Column) -> Column:
    """One newline off the end, then one carriage return."""
    return F.regexp_replace(F.regexp_replace(line, "\n\\z", ""), "\r\\z", "")


@F.pandas_udf(T.StringType())
def _repaired(raw: pd.Series) -> pd.Series:
    import re

    bad = re.compile("[\udc80-\udcff]+")
    return raw.map(lambda b: None if b is None else bad.sub("�", bytes(b).decode("utf-8", "surrogateescape")))


def valid_utf8(raw: Column) -> Column:
    """Text of bytes, each run of invalid ones as one U+FFFD. Only bytes that aren't valid go through Python."""
    return F.coalesce(F.try_validate_utf8(raw.cast("string")), _repaired(F.when(~F.is_valid_utf8(raw.cast("string")), raw)))


@F.pandas_udf(T.StringType())
def _compacted(texts: pd.Series) -> pd.Series:
    import re

    token = re.compile(r'"(?:[^"\\]|\\.)*"|[ \t\r\n]+')
    return texts.map(lambda t: None if t is None else token.sub(lambda m: m[0] if m[0][0] == '"' else "", t))


def compact_json(text: Column) -> Column:
    """JSON without white space outside strings; order of keys and forms of numbers stay. Already compact text stays in the JVM."""
    return F.when(~text.rlike(r"[ \t\r\n]"), text).otherwise(_compacted(F.when(text.rlike(r"[ \t\r\n]"), text)))


def glob_regex(pattern: str) -> str:
    """An anchored regular expression of a shell pattern with *, ? and [...], which don't match a slash; no braces."""
    import re

    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c in "*?":
            out += "[^/]*" if c == "*" else "[^/]"
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            out += "[" + pattern[i + 1 : end].replace("\\", "\\\\") + "]"
            i = end
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}\\z"


def metric_id(name: Column) -> Column:
    return F.concat(F.lit("app."), F.translate(name, ".", "_"))


def canonical_key(account: Column, region: Column, instance: Column, host: Column) -> Column:
    cloud = (F.coalesce(account, F.lit("")) != "") & (F.coalesce(region, F.lit("")) != "") & (F.coalesce(instance, F.lit("")) != "")
    return F.when(cloud, F.concat_ws(":", F.lit("aws"), account, region, F.lit("ec2"), instance)).when(F.coalesce(host, F.lit("")) != "", F.concat(F.lit("host:"), host))


def instance_document(text: Column) -> Column:
    """account, region, az, instance_id, instance_type, partition, arn of an instance document; null where a part is invalid."""
    d = F.from_json(text, "accountId string, region string, availabilityZone string, instanceId string, instanceType string")
    region, az = d["region"], d["availabilityZone"]
    partition = F.when(region.startswith("cn-"), "aws-cn").when(region.startswith("us-gov-"), "aws-us-gov").when(~region.contains("iso"), "aws")
    ok = d["accountId"].rlike(ACCOUNT) & region.rlike(REGION) & d["instanceId"].rlike(INSTANCE) & az.startswith(region) & (F.octet_length(az) <= 64) & (F.octet_length(d["instanceType"]) <= 128) & partition.isNotNull()
    arn = F.concat(F.lit("arn:"), partition, F.lit(":ec2:"), region, F.lit(":"), d["accountId"], F.lit(":instance/"), d["instanceId"])
    return F.when(ok, F.struct(d["accountId"].alias("account"), region.alias("region"), az.alias("az"), d["instanceId"].alias("instance_id"), d["instanceType"].alias("instance_type"), partition.alias("partition"), arn.alias("arn")))


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+\z", "")


def _safe(c: Column) -> Column:
    return (F.octet_length(c) > 0) & (F.octet_length(c) <= 256) & ~c.rlike("[\x00\r\n]")


def resolve_identity(configured: Column, evidence: Column, machine: Column) -> Column:
    """struct(agent_id, host_id, cloud, error): verified instance evidence names the host, else the machine id; a configured label names the agent."""
    given, machine = _trimmed(configured), _trimmed(machine)
    cloud = F.coalesce(evidence["verified"] & (evidence["provider"] == "aws") & (evidence["platform"] == "aws_ec2") & evidence["instance_id"].rlike(INSTANCE), F.lit(False))
    host = F.when(cloud, evidence["instance_id"]).when(_safe(machine), machine).otherwise("")
    agent = F.when(given != "", given).otherwise(host)
    error = F.when((given != "") & ~_safe(given), "configured_invalid").when(agent == "", "no_identity")
    none = F.lit(None).cast("string")
    return F.struct(F.when(error.isNull(), agent).otherwise(none).alias("agent_id"), F.when(error.isNull(), host).otherwise(none).alias("host_id"), (cloud & error.isNull()).alias("cloud"), error.alias("error"))


def valid_machine_id(c: Column) -> Column:
    return _trimmed(c).rlike(MACHINE)


def partial_success(signal: Column, body: Column) -> Column:
    """struct(outcome, rejected) of a 2xx response."""
    blank = F.coalesce(_trimmed(body), F.lit("")) == ""
    v = F.try_parse_json(body)
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    wrapped = F.try_variant_get(v, "$.data", "variant")
    inner = F.when(wrapped.isNotNull(), wrapped).otherwise(v)
    inner_ok = F.coalesce(F.schema_of_variant(inner).startswith("OBJECT"), F.lit(False))
    part = F.try_variant_get(inner, "$.partialSuccess", "variant")
    part = F.when(F.schema_of_variant(part) != "VOID", part)
    n = F.when(signal == "logs", F.try_variant_get(part, "$.rejectedLogRecords", "string")).otherwise(F.try_variant_get(part, "$.rejectedDataPoints", "string"))
    count = F.when(n.rlike(r"^[0-9]+\z"), F.expr("0").cast("long") + n.try_cast("long"))
    bad = (F.octet_length(body) > MAX_RESPONSE) | ~is_object | ~inner_ok | (part.isNotNull() & ~F.coalesce(F.schema_of_variant(part).startswith("OBJECT"), F.lit(False))) | (n.isNotNull() & (n != "") & count.isNull())
    outcome = F.when(blank, "accepted").when(bad, "rejected").when((count > 0) & (signal != "logs"), "rejected").otherwise("accepted")
    return F.struct(outcome.alias("outcome"), F.when(blank | bad, F.lit(0)).otherwise(F.coalesce(count, F.lit(0))).cast("long").alias("rejected"))


def classify_attempt(signal: Column, error: Column, status: Column, body: Column) -> Column:
    """accepted, rejected, unauthorized, cancelled or retry."""
    retry = (status == 429) | ((status >= 500) & ~status.isin(501, 505))
    return (
        F.when(error == "request", "unauthorized")
        .when(error.isin("tls", "redirect"), "rejected")
        .when(error == "cancelled", "cancelled")
        .when(error.isNotNull(), "retry")
        .when(status.isin(401, 403), "unauthorized")
        .when((status >= 200) & (status < 300), partial_success(signal, body)["outcome"])
        .when(retry, "retry")
        .otherwise("rejected")
    )


def retry_delay(signal: Column, header: Column, attempt: Column, now: Column, jitter: Column | None = None) -> Column:
    """Seconds until the next attempt: the server's own, else doubling up to 30; logs wait half an hour at most."""
    header = F.trim(F.coalesce(header, F.lit("")))
    seconds = F.when(header.rlike(r"^\+?[0-9]+\z"), header.try_cast("double"))
    # the three forms of a date in HTTP; a day of the month may be filled with a blank in the last
    spaced = F.regexp_replace(header, " +", " ")
    forms = [
        (r"^[A-Za-z]{3}, [0-9]{2} [A-Za-z]{3} [0-9]{4} [0-9:]{8} GMT\z", F.substring(header, 6, 20), "dd MMM yyyy HH:mm:ss"),
        (r"^[A-Za-z]{6,9}, [0-9]{2}-[A-Za-z]{3}-[0-9]{2} [0-9:]{8} GMT\z", F.regexp_extract(header, r", (.*) GMT\z", 1), "dd-MMM-yy HH:mm:ss"),
        (r"^[A-Za-z]{3} [A-Za-z]{3} +[0-9]{1,2} [0-9:]{8} [0-9]{4}\z", F.regexp_extract(spaced, r"^[A-Za-z]+ (.*)\z", 1), "MMM d HH:mm:ss yyyy"),
    ]
    date = F.coalesce(*[F.when(header.rlike(form), F.try_to_timestamp(text, F.lit(pattern))) for form, text, pattern in forms])
    until = F.when(date > now, date.cast("double") - now.cast("double"))
    own = F.least(F.pow(F.lit(2.0), attempt), F.lit(30.0)) + (jitter if jitter is not None else F.lit(0.0))
    delay = F.coalesce(seconds, until, own)
    return F.when(signal == "logs", F.least(delay, F.lit(1800.0))).otherwise(delay)


def verify_record(version: Column, payload: Column, digest: Column, admission: Column | None = None) -> Column:
    """True for a record of version 1 whose payload is JSON and has the digest (and whose admission id is 64 hex digits)."""
    ok = (version == 1) & F.try_parse_json(payload).isNotNull() & (F.sha2(payload.cast("binary"), 256) == digest)
    if admission is not None:
        ok = ok & admission.rlike(r"^[0-9a-fA-F]{64}\z")
    return F.coalesce(ok, F.lit(False))
