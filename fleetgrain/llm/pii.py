"""Personal data: fixed forms, and unseen identifiers found by bootstrapped contexts.

Base entities are emails, IPv4 addresses, card numbers and phone numbers of fixed forms. They are the seeds. A token shaped like an
identifier (with a digit, `@`, `_` or a dot between letters, of MIN_SIZE characters or more, not part of a base entity) is a
candidate. An occurrence has up to three lexical patterns, from the fullest context to shorter ones: the two words before it and
the one after, the word before and the word after, the two words before; all lower-cased and whole, however far away.

Patterns and instances form a bipartite graph. Seeds score 1, other instances 0 at first. In a round, a pattern's confidence is the sum
of its instances' scores over their number plus SMOOTH; it is trusted at CONFIDENCE with SUPPORT or more distinct instances that are seeds or already
discovered. Every candidate in trusted patterns is discovered; its score is the noisy-or of their confidences, and so it lends support
to other patterns in the next round, whether these have seeds or not. Scores and trusted patterns only grow; rounds end when no
pattern is added and the confidences of all patterns together grow by less than STILL. Occurrences of candidates in trusted patterns become spans, of the kind that most trusted instances of the
pattern have.

Instances of equal text are one node; occurrences are aggregated to (pattern, instance) before any join, and patterns of SUPPORT instances
or fewer can discover nothing and are left out at once. Rounds are equi-joins and aggregations; a pattern or instance with a large share
of all edges is joined by broadcast (common.by_key). Texts are scanned in linear time.

Nulls: a null text is the empty text and has no span. A null doc_id is kept. Repeated rows are each scanned. Empty tables give empty
results. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# The forms of the base entities.
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

MIN_SIZE = 5
#: Rounds end when all confidences together grow by less.
STILL = 1e-6
SMOOTH = 0.5
SUPPORT = 3
CONFIDENCE = 0.6

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# as IP matches: a match can only begin where a run of digits does, and none of its runs is ever given back
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD, _PHONE = re.compile(CARD), re.compile(PHONE)
_DIGIT = re.compile(r"[0-9]")
_RUN = re.compile(r"[A-Za-z0-9_/+=@.:\-]+")
_SHAPED = re.compile(r"[0-9@_]|[A-Za-z]\.[A-Za-z]")
_WORD = re.compile(r"[^\W\d_]+")
#: A name of a pattern or instance in the graph; longer ones are named by their hash.
_NAME = 200


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """As EMAIL finds them, but searched from the @, so that time grows with the text and not with its words' lengths."""
    out, free = [], 0
    for m in _AT.finditer(text) if "@" in text else ():
        start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append((start, m.end()))
            free = m.end()
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base entities, by kind as listed, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text) is None:
        return out
    for m in _IP.finditer(text):
        if all(int(p) <= 255 if len(p) < 9 else int(p.lstrip("0")[:9] or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def _named(text: str) -> str:
    return text if len(text) <= _NAME else f"#{xxhash.xxh3_128_hexdigest(text)}"


class _Context:
    """The words of a text by position."""

    def __init__(self, text: str):
        self.text = text
        at = np.fromiter(chain.from_iterable(m.span() for m in _WORD.finditer(text)), np.int64)
        self.starts, self.ends = at[::2], at[1::2]

    def word(self, k: int) -> str | None:
        return self.text[self.starts[k] : self.ends[k]].lower() if 0 <= k < len(self.starts) else None

    def patterns(self, start: int, end: int) -> list[str]:
        last = int(np.searchsorted(self.ends, start, "right"))
        two, one = self.word(last - 2), self.word(last - 1)
        then = self.word(int(np.searchsorted(self.starts, end, "left")))
        forms = [(two, one, "_", then), (one, "_", then), (two, one, "_")]
        return [_named(" ".join(f)) for f in forms if None not in f]


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Where tokens stand that may be identifiers and are no part of a base entity."""
    taken = sorted((a, b) for _, a, b in base)
    ends = list(np.maximum.accumulate([b for _, b in taken])) if taken else []
    out, k = [], 0
    for m in _RUN.finditer(text):
        token = m[0].strip("/+=@.:-")
        a = m.start() + m[0].find(token)
        b = a + len(token)
        while k < len(taken) and ends[k] <= a:
            k += 1
        if b - a >= MIN_SIZE and not (k < len(taken) and taken[k][0] < b) and _SHAPED.search(token):
            out.append((a, b))
    return out


_SPAN = [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]
_FOUND = [("patterns", pa.list_(pa.string())), ("instance", pa.string()), *_SPAN]
_SCANNED = "doc_id long, base array<struct<kind:string,start:int,end:int>>, found array<struct<patterns:array<string>,instance:string,kind:string,start:int,end:int>>"
#: What a text needs for any base entity or candidate.
_ANY = re.compile(r"[0-9@_]|[A-Za-z]\.[A-Za-z]")


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, base spans, and all occurrences (seeds with their kind, candidates with none) with patterns and instance."""
    common.small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            bases, founds = [], []
            for text in common.col(batch, "text").fill_null("").to_pylist():
                base, found = [], []
                if _ANY.search(text):
                    base = base_spans(text)
                    spans = base + [(None, a, b) for a, b in candidates(text, base)]
                    context = _Context(text) if spans else None
                    found = [{"patterns": context.patterns(a, b), "instance": _named(text[a:b]), "kind": kind, "start": a, "end": b} for kind, a, b in spans]
                bases.append([{"kind": kind, "start": a, "end": b} for kind, a, b in base])
                founds.append(found)
            columns = [common.col(batch, "doc_id"), pa.array(bases, pa.list_(pa.struct(_SPAN))), pa.array(founds, pa.list_(pa.struct(_FOUND)))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "base", "found"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCANNED)


def patterns(edges: DataFrame, rounds: int | None = None, smooth: float = SMOOTH, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """pattern, kind, confidence and n (its edges) of the trusted patterns; edges: (pattern, instance, kind), kind null for candidates.

    Scores and confidences only grow and are bounded, so rounds come to an end by themselves; rounds, if given, ends them sooner.
    """
    links = edges.groupBy("pattern", "instance").agg(F.max("kind").alias("kind"))
    links = common.stored(links, "pii-edges")
    wide = common.stored(links.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") > support), "pii-wide")
    links = common.stored(common.by_key(links, wide, "pattern", links.count()), "pii-links")
    total = links.count()
    each = links.groupBy("instance").agg(F.max("kind").alias("seed"), F.count("*").alias("n"))
    each = common.stored(each, "pii-instances")
    seeds = each.where("seed is not null").select("instance", F.lit(1.0).alias("score"), F.col("seed").alias("as"), "n")
    scores = seeds
    before = None
    for done in count(1):
        held = common.by_key(links.select("pattern", "instance"), scores, "instance", total, "left")
        counts = [F.count_if((F.col("as") == k) & (F.col("score") >= confidence)).alias(k) for k in KINDS]
        sums = held.groupBy("pattern").agg(F.count("*").alias("n"), F.sum(F.coalesce("score", F.lit(0.0))).alias("sum"), *counts)
        most = F.array_max(F.array(*[F.struct(F.col(k).alias("k"), F.lit(k).alias("kind")) for k in KINDS]))["kind"]
        sums = sums.select("pattern", "n", (F.col("sum") / (F.col("n") + F.lit(smooth))).alias("confidence"), sum(F.col(k) for k in KINDS).alias("support"), most.alias("kind"))
        sums = common.stored(sums, "pii-sums")
        trusted = sums.where((F.col("confidence") >= confidence) & (F.col("support") >= support)).drop("support")
        now = sums.agg(F.coalesce(F.sum("confidence"), F.lit(0.0)), F.count_if((F.col("confidence") >= confidence) & (F.col("support") >= support))).first()
        # without a trusted pattern nothing is discovered; else all confidences and the trusted set must stand still
        if not now[1] or done == rounds or (before is not None and now[1] == before[1] and now[0] - before[0] < STILL):
            break
        before = now
        unseen = common.by_key(links.where("kind is null").select("pattern", "instance"), trusted, "pattern", total)
        miss = F.sum(F.log(1 - F.least("confidence", F.lit(0.999))))
        found = unseen.groupBy("instance").agg((1 - F.exp(miss)).alias("score"), F.max_by("kind", F.struct("confidence", "kind")).alias("as"))
        found = found.join(each.where("seed is null").select("instance", "n"), "instance")
        scores = common.stored(seeds.unionByName(found), "pii-scores")
    return trusted


def personal_data(documents: DataFrame, rounds: int | None = None, smooth: float = SMOOTH, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """doc_id, base (spans of the fixed forms) and added (spans found by trusted patterns) of each document."""
    rows = common.stored(scan(documents).withColumn("row", F.monotonically_increasing_id()), "pii-occurrences")
    found = rows.select("row", F.explode("found").alias("o")).select("row", "o.*")
    edges = found.select(F.explode("patterns").alias("pattern"), "instance", "kind")
    trusted = patterns(edges, rounds, smooth, support, confidence).select("pattern", "confidence", F.col("kind").alias("as_kind"), "n")
    trusted = common.stored(trusted, "pii-trusted")
    seen = found.where("kind is null").select("row", "start", "end", F.explode("patterns").alias("pattern"))
    more = common.by_key(seen, trusted, "pattern", trusted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    more = more.groupBy("row", "start", "end").agg(F.max_by("as_kind", F.struct("confidence", "as_kind")).alias("kind"))
    more = more.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("added"))
    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)")
    return rows.select("row", "doc_id", "base").join(more, "row", "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))


def joined(spans, kinds: tuple[str, ...] = KINDS):
    """kind:start:end of all spans, by kind as listed, then start."""
    place = lambda s: F.array_position(F.array(*map(F.lit, kinds)), s["kind"])
    order = F.array_sort(F.transform(spans, lambda s: F.struct(place(s).alias("p"), s["start"].alias("s"), s["end"].alias("e"), s["kind"].alias("k"))))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", s["k"], s["s"].cast("string"), s["e"].cast("string"))), ",")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = personal_data(common.table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    return got.select(
        "doc_id",
        *counts,
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
        F.size(F.concat("base", "added")).cast("long").alias("n_spans"),
    )
