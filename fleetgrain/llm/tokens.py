"""Token ids in directly addressable codes (DAC).

A shard file holds the ids of consecutive documents, in ascending doc_id order. Every id is cut into chunks, low bits first; the
chunks of level k of all ids that reach it stand together, with a bitmap that says which ids go on to level k + 1, and a rank
directory that counts the bitmap's ones before every RANK_BITS-th bit. Token i is read from level 0 at i; while the bitmap has
its bit set, its place in the next level is the rank of that bit: no block is decoded and nothing before i is read.

Layout (little-endian): magic, levels, documents, tokens; document ids and the end of each document (uint64); for each level its
width in bits, count, chunks (uint8 or uint16), bitmap and directory (uint32). Shards are rows of a Parquet table
written by Spark, so the commit is Spark's: an attempt of a lost executor leaves nothing behind.

Tokenising: text is cut where the tokenizer's own pre-tokenizer is sure to cut (before a run of white space, between letters or
digits and punctuation) and around the file's added tokens, equal pieces are encoded once per worker and the ids are put back
in place. Pieces are looked up by a hash and compared byte for byte; one whose hash is another piece's is encoded by itself. The
result equals that of encoding whole texts with the tokenizer as its file has it (add_special_tokens=False).

Nulls: a null text is the empty text (only the end id); a null doc_id sorts first. Repeated doc_ids follow each other, ordered by
their ids' bytes. Empty tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
WIDTHS = (8, 8, 8, 8)
RANK_BITS = 512
#: Tokens of a shard at which the next begins (a longer document is a shard of its own).
SHARD_TOKENS = 1 << 20
#: Pieces that a worker keeps encoded.
CACHE_PIECES = 1_500_000
MAGIC = b"DACTOK1\n"


# ---- codes ----------------------------------------------------------------------------------------------------------


def _level(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Low chunks of values, and which of them go on."""
    kind = np.uint8 if width <= 8 else np.uint16
    return (values & np.uint32((1 << width) - 1)).astype(kind), (values >> np.uint32(width)) > 0


def encode_shard(ids: np.ndarray, doc_ids: np.ndarray, ends: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> bytes:
    """The shard file of ids (uint32); document k has the ids before ends[k] and from ends[k - 1]."""
    parts, values = [], ids.astype(np.uint32)
    for k, width in enumerate(widths):
        if k and not len(values):
            break
        chunks, more = _level(values, width) if sum(widths[: k + 1]) < 32 else (values.astype(np.uint8 if width <= 8 else np.uint16), np.zeros(len(values), bool))
        bits = np.packbits(more, bitorder="little")
        whole = np.zeros(-(-len(more) // RANK_BITS) * RANK_BITS, np.uint8)
        whole[: len(more)] = more
        directory = np.zeros(len(whole) // RANK_BITS, np.uint32)
        if len(directory) > 1:
            directory[1:] = np.cumsum(whole.reshape(-1, RANK_BITS).sum(1))[:-1]
        parts += [struct.pack("<BBQ", width, chunks.itemsize, len(values)), chunks.tobytes(), bits.tobytes(), directory.tobytes()]
        values = values[more] >> np.uint32(width)
    levels = len(parts) // 4
    head = MAGIC + struct.pack("<BQQ", levels, len(doc_ids), len(ids))
    return b"".join([head, doc_ids.astype(np.int64).tobytes(), ends.astype(np.uint64).tobytes(), *parts])


class Shard:
    """Reads a shard file; token(i) touches one chunk, bit and directory entry per level."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token shard")
        levels, docs, self.tokens = struct.unpack_from("<BQQ", data, 8)
        at = 25
        self.doc_ids = np.frombuffer(data, np.int64, docs, at)
        self.ends = np.frombuffer(data, np.uint64, docs, at + 8 * docs).astype(np.int64)
        at += 16 * docs
        self.levels = []
        for _ in range(levels):
            width, item, n = struct.unpack_from("<BBQ", data, at)
            at += 10
            chunks = np.frombuffer(data, np.uint8 if item == 1 else np.uint16, n, at)
            at += item * n
            bits = np.frombuffer(data, np.uint8, -(-n // 8), at)
            at += len(bits)
            directory = np.frombuffer(data, np.uint32, -(-n // RANK_BITS), at)
            at += 4 * len(directory)
            self.levels.append((width, chunks, bits, directory))
        if at != len(data):
            raise ValueError("a token shard of another length")

    def token(self, i: int) -> int:
        value = shift = 0
        for width, chunks, bits, directory in self.levels:
            value |= int(chunks[i]) << shift
            shift += width
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            block = i // RANK_BITS
            first = block * RANK_BITS // 8
            i_byte = i >> 3
            i = int(directory[block]) + int(np.bitwise_count(bits[first:i_byte]).sum()) + (int(bits[i_byte]) & ((1 << (i & 7)) - 1)).bit_count()
        raise ValueError("a token goes on beyond the last level")

    def all(self) -> np.ndarray:
        """All ids, from the last level up."""
        out = None
        for width, chunks, bits, _ in reversed(self.levels):
            here = chunks.astype(np.uint32)
            more = np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)
            if out is not None:
                here[more] |= out << np.uint32(width)
            elif more.any():
                raise ValueError("a token goes on beyond the last level")
            out = here
        return out if out is not None else np.zeros(0, np.uint32)


# ---- tokenizing -----------------------------------------------------------------------------------------------------

_LETTER, _DIGIT, _OTHER, _QUOTE, _SPACE, _WHITE, _HIGH, _ODD = range(8)


def _classes() -> np.ndarray:
    kind = np.full(256, _OTHER, np.uint8)
    kind[0x30:0x3A] = _DIGIT
    kind[0x41:0x5B] = kind[0x61:0x7B] = _LETTER
    kind[0x27], kind[0x20] = _QUOTE, _SPACE
    kind[0x09:0x0E] = _WHITE
    kind[0x1C:0x20] = _ODD
    kind[0x80:] = _HIGH
    return kind


_KINDS = _classes()
#: Kinds between which the pre-tokenizer always cuts.
_CUT = np.zeros((8, 8), bool)
for _a in (_LETTER, _DIGIT, _OTHER, _QUOTE, _HIGH):
    _CUT[_a, [_SPACE, _WHITE]] = True
for _a, _b in ((_LETTER, _DIGIT), (_LETTER, _OTHER), (_DIGIT, _OTHER)):
    _CUT[_a, _b] = _CUT[_b, _a] = True
_CUT[_LETTER, _QUOTE] = _CUT[_DIGIT, _QUOTE] = True
_CUT[_WHITE, [_LETTER, _DIGIT, _OTHER, _QUOTE, _HIGH]] = True


def piece_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where pieces start. Every document starts a piece; the pieces' encodings, joined, are the document's."""
    n = len(data)
    kind = _KINDS[data]
    lead = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
    if len(lead):  # characters that may be white space beyond ASCII: no cut beside them
        two = np.append(data[1:], 0)[lead]
        odd = lead[(data[lead] != 0xC2) | (two == 0x85) | (two == 0xA0)]
        for k in range(3):
            where = odd + k
            where = where[where < n]
            kind[where[data[where] >= 0x80]] = _ODD
    cut = np.empty(n, bool)
    cut[0] = True
    cut[1:] = _CUT[kind[:-1], kind[1:]]
    white = (kind == _SPACE) | (kind == _WHITE) | (kind == _ODD)
    # a run of white space is cut only before its first character (above); inside, the whole run and the word after it stay one piece
    run = np.zeros(n, bool)
    run[1:] = white[1:] & white[:-1]
    if run.any():
        # no cut between the last of a longer run and what follows
        cut[np.flatnonzero(run[:-1] & ~white[1:]) + 1] = False
    cut[at[:-1][at[:-1] < n]] = True
    return np.flatnonzero(cut)


def _byte_chars() -> np.ndarray:
    """The character by which a byte-level tokenizer writes each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    to = np.zeros(256, "<u2")
    to[shown] = shown
    hidden = [b for b in range(256) if b not in shown]
    to[hidden] = 256 + np.arange(len(hidden))
    return to


_BYTE_CHARS = _byte_chars()


def _letters(data: np.ndarray) -> np.ndarray:
    """Bytes of ASCII letters and of U+00C0 to U+024F without the two signs there."""
    kind = _KINDS[data]
    out = kind == _LETTER
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC9))
    if len(lead):
        then = data[np.minimum(lead + 1, len(data) - 1)]
        lead = lead[~((data[lead] == 0xC3) & ((then == 0x97) | (then == 0xB7))) & ~((data[lead] == 0xC9) & (then > 0x8F))]
        out[lead] = out[lead + 1] = True
    return out


class Encoder:
    """Encodes documents with the tokenizer as it is loaded; pieces seen before come from a bounded cache.

    Each occurrence of one of the file's added tokens is a piece of its own.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        for token in added.values():
            if token.lstrip or token.rstrip or token.single_word or (token.normalized and self.tokenizer.normalizer is not None):
                raise ValueError(f"an added token that reaches beyond its own text: {token.content}")
        # the leftmost occurrence, and of those at one place the longest, as the tokenizer has it
        forms = sorted((t.content.encode() for t in added.values()), key=len, reverse=True)
        self.find_added = re.compile(b"|".join(map(re.escape, forms))) if forms else None
        self.clear()

    def clear(self) -> None:
        """An empty cache: hashes of pieces, their bytes and their ids (where they begin and how many they are)."""
        self.keys = np.zeros(0, np.uint64)
        self.text, self.text_at, self.size = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.first, self.count = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _equal(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Which pieces of data have the very bytes of the cached pieces at place."""
        same = self.size[place] == sizes
        some = np.arange(len(starts)) if same.all() else np.flatnonzero(same)
        if not len(some):
            return same
        n = sizes[some]
        upto = np.cumsum(n)
        at = np.arange(upto[-1])
        held = self.text[at + np.repeat(self.text_at[place[some]] - (upto - n), n)]
        here = data if len(some) == len(starts) else data[at + np.repeat(starts[some] - (upto - n), n)]
        off = np.flatnonzero(held != here)
        same[some[np.searchsorted(upto, off, "right")]] = False
        return same

    def _encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of the pieces, their ids in it, and how many each has.

        A piece of Latin letters, with or without a space before, is one pre-token: the tokenizer's model takes it as it is.
        The others go through the whole tokenizer.
        """
        odd = np.append(0, np.cumsum(~_letters(data)))
        plain = odd[ends] - odd[starts + (data[starts] == 0x20)] == 0
        plain &= ends - starts > (data[starts] == 0x20)
        order = np.argsort(~plain, kind="stable")
        n = int(plain.sum())
        text = _BYTE_CHARS[data].tobytes().decode("utf-16-le")
        tokenize = self.tokenizer.model.tokenize
        lists = [[t.id for t in tokenize(text[a:b])] for a, b in zip(starts[order[:n]].tolist(), ends[order[:n]].tolist(), strict=True)]
        whole = data.tobytes()
        rest = [whole[a:b].decode() for a, b in zip(starts[order[n:]].tolist(), ends[order[n:]].tolist(), strict=True)]
        lists += [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        return order, np.fromiter(chain.from_iterable(lists), np.uint32, int(counts.sum())), counts

    def _starts(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where pieces start; an added token is one."""
        spans = [m.span() for m in self.find_added.finditer(data.tobytes())] if self.find_added else []
        if spans:
            # none across two documents; a scan of each document finds what such a one hid
            inner = at[(at > 0) & (at < len(data))]
            if any(np.searchsorted(inner, a, "right") != np.searchsorted(inner, b, "left") for a, b in spans):
                spans = [(a + m.start(), a + m.end()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True) for m in self.find_added.finditer(data[a:b].tobytes())]
        if not spans:
            return piece_starts(data, at)
        edges = np.array(spans, np.int64)
        # the text between added tokens is encoded as if it stood alone
        cuts = np.unique(np.concatenate([at, edges.ravel()]))
        starts = piece_starts(data, cuts)
        held = np.searchsorted(edges[:, 1], starts, "right")
        inside = (held < len(edges)) & (starts > edges[np.minimum(held, len(edges) - 1), 0])
        return starts[~inside]

    def documents(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a slice, and how many each has."""
        docs = len(at) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(docs, np.int64)
        starts = self._starts(data, at)
        ends = np.append(starts[1:], len(data))
        sizes = ends - starts
        keys, where, back = np.unique(common.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, keys)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == keys[known]
        new = np.flatnonzero(~known)
        if len(new):
            if len(self.keys) + len(new) > CACHE_PIECES and len(self.keys):
                self.clear()
                new = np.arange(len(keys))
            own = where[new]
            order, got, counts = self._encode(data, starts[own], ends[own])
            firsts = len(self.ids) + np.cumsum(counts) - counts
            back_in_order = np.argsort(order)
            firsts, counts = firsts[back_in_order], counts[back_in_order]
            upto = np.cumsum(sizes[own])
            text = data[np.arange(upto[-1]) + np.repeat(starts[own] - (upto - sizes[own]), sizes[own])]
            into = np.searchsorted(self.keys, keys[new])
            self.size = np.insert(self.size, into, sizes[own])
            self.text_at = np.insert(self.text_at, into, len(self.text) + upto - sizes[own])
            self.text = np.concatenate([self.text, text])
            self.keys, self.first, self.count = np.insert(self.keys, into, keys[new]), np.insert(self.first, into, firsts), np.insert(self.count, into, counts)
            self.ids = np.concatenate([self.ids, got])
            place = np.searchsorted(self.keys, keys)
        place = place[back]
        first, count, ids = self.first[place], self.count[place], self.ids
        other = np.flatnonzero(~self._equal(data, starts, sizes, place))
        if len(other):  # the hash of another piece
            order, got, counts = self._encode(data, starts[other], ends[other])
            first[other[order]], count[other[order]] = len(ids) + np.cumsum(counts) - counts, counts
            ids = np.concatenate([ids, got])
        total = np.cumsum(count)
        index = np.arange(total[-1]) + np.repeat(first - (total - count), count)
        owner = np.searchsorted(starts, at, "left")  # the first piece of each document
        upto = np.append(0, total)[owner]
        return ids[index], np.diff(upto)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def packed(ids: np.ndarray) -> bytes:
    """Ids for a shuffle: their bytes by significance, compressed."""
    return zstandard.compress(np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def encoded(documents: DataFrame, path: str, end_id: int = END_ID, bounds: list[float] | None = None) -> DataFrame:
    """doc_id, bucket (how many of the ascending bounds are below the doc_id, plus 1; null: 0), ids (packed, with the end id)."""
    common.small_batches(documents.sparkSession)
    limits = np.array(bounds or [], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in common.slices(batches):
            data, at = common.raw(common.utf8(common.col(batch, "text")))
            ids, counts = enc.documents(data, at)
            upto = np.append(0, np.cumsum(counts))
            rows = [packed(np.append(ids[a:b], np.uint32(end_id))) for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
            docs = common.col(batch, "doc_id")
            bucket = np.searchsorted(limits, docs.fill_null(0).to_numpy().astype(np.float64)) + 1
            bucket[docs.is_null().to_numpy(zero_copy_only=False)] = 0
            yield pa.RecordBatch.from_arrays([docs, pa.array(bucket.astype(np.int32)), pa.array(rows, pa.binary())], names=["doc_id", "bucket", "ids"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, bucket int, ids binary")


def write_shards(documents: DataFrame, path: str, tokenizer: str, shard_tokens: int = SHARD_TOKENS, end_id: int = END_ID) -> None:
    """Writes the shard table: (part, shard, documents, tokens, file), ordered by doc_id over part and shard.

    Parts are ranges of doc_id between quantiles, which a scan of that column alone finds. One shuffle, of the compressed ids, by
    part (several a task); within a part, documents are sorted and cut into shards.
    """
    spark = documents.sparkSession
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = 4 * tasks
    bounds = documents.select(F.col("doc_id").cast("double").alias("doc_id")).where("doc_id is not null").approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.25 / parts)
    rows = encoded(documents, tokenizer, end_id, sorted(set(bounds)))
    ordered = rows.repartition(tasks, "bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard = -1, 0
        held: list[tuple[int | None, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nulls = sum(d is None for d, _ in held)
            file = encode_shard(np.concatenate([x for _, x in held]), np.array([d if d is not None else 0 for d, _ in held], np.int64), np.cumsum([len(x) for _, x in held]))
            return pa.RecordBatch.from_pydict({"part": [part], "shard": [shard], "null_ids": [nulls], "documents": [len(held)], "tokens": [size], "file": [file]}, schema=pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("null_ids", pa.int64()), ("documents", pa.int64()), ("tokens", pa.int64()), ("file", pa.binary())]))

        for batch in batches:
            for doc, bucket, data in zip(common.col(batch, "doc_id").to_pylist(), common.col(batch, "bucket").to_pylist(), common.col(batch, "ids"), strict=True):
                ids = unpacked(data.as_py())
                if held and (bucket != part or size + len(ids) > shard_tokens):
                    yield flush()
                    shard, held, size = shard + 1, [], 0
                if bucket != part:
                    part, shard = bucket, 0
                held.append((doc, ids))
                size += len(ids)
        if held:
            yield flush()

    ordered.mapInArrow(run, "part int, shard int, null_ids long, documents long, tokens long, file binary").write.option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the shard files.

    start is global: the tokens of all shards before (a running sum over the shards' counts, a narrow row each) and those
    before the document in its shard.
    """
    shards = spark.read.parquet(path)
    per_part = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    narrow = shards.select("part", "shard", "tokens")
    parts = narrow.groupBy("part").agg(F.sum("tokens").alias("t")).withColumn("part_base", F.coalesce(F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("t")
    bases = narrow.withColumn("in_part", F.coalesce(F.sum("tokens").over(per_part), F.lit(0))).join(parts, "part").select("part", "shard", (F.col("part_base") + F.col("in_part")).cast("long").alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, nulls, file in zip(*(common.col(batch, c).to_pylist() for c in ("part", "shard", "null_ids")), common.col(batch, "file"), strict=True):
                got = Shard(file.as_py())
                ids = got.all()
                starts = np.append(0, got.ends[:-1])
                data = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), got.ends.tolist(), strict=True)]
                docs = pa.array([None] * nulls + got.doc_ids[nulls:].tolist(), pa.int64())
                n = len(docs)
                yield pa.RecordBatch.from_arrays([docs, pa.array(starts), pa.array(got.ends - starts), pa.array(crcs, pa.int64()), pa.array([part] * n, pa.int32()), pa.array([shard] * n, pa.int32())], names=["doc_id", "offset", "n_tokens", "ids_crc32", "part", "shard"])

    read = shards.select("part", "shard", "null_ids", "file").mapInArrow(run, "doc_id long, offset long, n_tokens long, ids_crc32 long, part int, shard int")
    return read.join(bases, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def token_files(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Encodes, writes shards to the shared folder and returns what is read back."""
    import public_tokenizers

    spark = documents.sparkSession
    path = common.fresh_path(spark, "token-shards")
    write_shards(documents, path, tokenizer or public_tokenizers.path(TOKENIZER))
    return read_shards(spark, path)


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(common.table(spark, sf_dir, "documents"))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the token files of the documents."""
    return token_files(docs)
