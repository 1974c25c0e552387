"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark items.

Words are the runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z. Every ``window`` consecutive words of an item
are a pattern (an item of fewer words, but not none, is one pattern). The automaton's alphabet is the vocabulary of the
benchmark: a text is read once, each word becomes its number (0 if no item has it) and the automaton walks the numbers.

Nulls: a null text has no words; an item of a null item_id is looked for and counts as hit words, but isn't in the list of items. Repeated items and repeated documents each count as a row; items
with the same id count once in a document's item list. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 10
#: Bytes of benchmark text for which one automaton is built; a larger benchmark is dealt to several, each scanning once.
AUTOMATON_BYTES = 8 << 20

_TO_WORDS = bytes(b if b else 0x20 for b in common.word_table().tolist())
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # as they stand in the original
_SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>, hit_words binary"


def words_of(text: str | bytes | None) -> list[bytes]:
    """The normalised words of a text."""
    data = text.encode() if isinstance(text, str) else text or b""
    return data.translate(_TO_WORDS).split()


class Automaton:
    """Patterns of word numbers, each with the items that hold it."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        import ahocorasick

        self.numbers: dict[bytes, int] = {}
        patterns: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            words = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)]
            for i in range(max(1, len(words) - window + 1) if words else 0):
                held = patterns.setdefault(tuple(words[i : i + window]), set())
                if item is not None:
                    held.add(item)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, held in patterns.items():
            self.machine.add_word(key, (len(key), sorted(held)))
        self.empty = not patterns
        if not self.empty:
            self.machine.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words lie in an occurrence of a pattern, and the items with one."""
        hit, found = np.zeros(0, bool), set()
        if self.empty or not words:
            return hit, found
        get = self.numbers.get
        spans = []
        for end, (length, items) in self.machine.iter(tuple([get(w, 0) for w in words])):
            spans.append((end + 1 - length, end + 1))
            found.update(items)
        if spans:
            edge = np.zeros(len(words) + 1, np.int64)
            at = np.array(spans)
            np.add.at(edge, at[:, 0], 1)
            np.add.at(edge, at[:, 1], -1)
            hit = np.cumsum(edge[:-1]) > 0
        return hit, found

    def hits(self, words: list[bytes]) -> bool:
        """Whether any pattern occurs."""
        if self.empty or not words:
            return False
        get = self.numbers.get
        return next(self.machine.iter(tuple([get(w, 0) for w in words])), None) is not None


def original_spans(text: str, hit: np.ndarray) -> list[dict]:
    """Character ranges, in the text as given, of the runs of hit words."""
    out: list[dict] = []
    last = -2
    for i, m in enumerate(_WORD.finditer(text)):
        if hit[i]:
            if i == last + 1:
                out[-1]["end"] = m.end()
            else:
                out.append({"start": m.start(), "end": m.end()})
            last = i
    return out


_BUILT: dict[str, Automaton] = {}


def _in_order(rows: list) -> list[tuple[str | None, bytes]]:
    return sorted(((r.item, bytes(r.text)) for r in rows), key=lambda x: (x[0] is None, x[0] or "", x[1]))


def _shipped(spark: SparkSession, items: list[tuple[str | None, bytes]], window: int) -> Callable[[], Automaton]:
    """The automaton of items, for tasks; a reused worker keeps it."""
    shared = spark.sparkContext.broadcast(items)
    key = hashlib.sha256(repr((window, items)).encode()).hexdigest()

    def built() -> Automaton:
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = Automaton(shared.value, window)
        return _BUILT[key]

    return built


def _clean(documents: DataFrame, items: list[tuple[str | None, bytes]], window: int = WINDOW) -> DataFrame:
    """The rows of documents without a hit."""
    automaton = _shipped(documents.sparkSession, items, window)
    common.small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in common.slices(batches):
            yield batch.filter(pa.array([not machine.hits(words_of(text)) for text in common.utf8(common.col(batch, "text")).to_pylist()]))

    return documents.mapInArrow(run, documents.schema)


def _scan_all(documents: DataFrame, items: list[tuple[str | None, bytes]], window: int) -> DataFrame:
    automaton = _shipped(documents.sparkSession, items, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in common.slices(batches):
            rows = []
            for text in common.utf8(common.col(batch, "text")).to_pylist():
                words = words_of(text)
                hit, found = machine.scan(words)
                some = bool(len(hit)) and bool(hit.any())
                rows.append((len(words), int(hit.sum()), sorted(found), original_spans(text.decode(), hit) if some else [], np.packbits(hit).tobytes()))
            ids = common.col(batch, "doc_id").cast(pa.int64())
            n, h, i, s, w = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(h, pa.int64()), pa.array(i, pa.list_(pa.string())), pa.array(s, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(w, pa.binary())],
                names=["doc_id", "n_words", "n_hit", "items", "spans", "hit_words"],
            )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCHEMA)


def _items(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """The distinct items (item, text) that have a text, and their bytes."""
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text")).distinct()
    return items, items.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids as text, sorted) and spans (original character ranges of hit runs) of each document.

    The benchmark's size is summed first. Within automaton_bytes one automaton serves the single scan. A larger benchmark is
    dealt by hash to as many parts as keep each within that bound on average; each part scans the texts once and the parts'
    hit words are united per row, so any size of benchmark is served with bounded memory.
    """
    spark = documents.sparkSession
    common.small_batches(spark)
    items, size = _items(benchmark)
    parts = -(-size // automaton_bytes) or 1
    if parts == 1:
        return _scan_all(documents, _in_order(items.collect()), window).drop("hit_words")
    kept = common.stored(documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "decontamination")
    found = []
    for part in range(parts):
        held = _in_order(items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part).collect())
        # the row's number stands in for doc_id, so that repeated ids stay apart
        found.append(_scan_all(kept.select(F.col("row").alias("doc_id"), "text"), held, window))
    union = found[0]
    for other in found[1:]:
        union = union.unionByName(other)
    merged = union.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.collect_list("hit_words").alias("bits"))
    rejoined = merged.withColumnRenamed("doc_id", "row").join(kept, "row")

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            hits, spans = [], []
            for n, bits, text in zip(common.col(batch, "n_words").to_pylist(), common.col(batch, "bits").to_pylist(), common.col(batch, "text").to_pylist(), strict=True):
                hit = np.zeros(n, bool)
                for b in bits:
                    if b:
                        hit |= np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool)
                hits.append(int(hit.sum()))
                spans.append(original_spans(text, hit) if hit.any() else [])
            yield pa.RecordBatch.from_arrays(
                [common.col(batch, "doc_id"), common.col(batch, "n_words"), pa.array(hits, pa.int64()), common.col(batch, "items").cast(pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                names=["doc_id", "n_words", "n_hit", "items", "spans"],
            )

    return rejoined.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", "items", "bits", "text").mapInArrow(unite, "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contamination of every document by the benchmark table."""
    found = contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows without any benchmark window, whole; only the rows hit are dropped, not others of their doc_id."""
    benchmark = common.table(spark, sf_dir, "benchmark")
    items, size = _items(benchmark)
    if size <= AUTOMATON_BYTES:  # filtered in the scan itself
        return _clean(docs, _in_order(items.collect()))
    row = common.free_name(docs, "row")
    rows = common.stored(docs.withColumn(row, F.monotonically_increasing_id()), "decontamination-rows")
    # the row's number stands in for doc_id
    found = contamination(rows.select(F.col(row).alias("doc_id"), "text"), benchmark)
    hit = common.stored(found.where(F.col("n_hit") > 0).select(F.col("doc_id").alias(row)), "decontamination-hit")
    return common.matched(rows, hit, row, "left_anti").select(docs.columns)
