"""Language-model scores by logistic context mixing: hashed-context bit predictors, gated weights and an adaptive last map.

A text is its lower-cased (A-Z) words and an end, with a blank after each. The model codes these bytes one after another, bit by bit, high bits first.
Five predictors say how likely a bit is, each from counts of training bytes: by the byte before, by two, three and four bytes before (contexts hashed to
CONTEXT_BITS bits), whichever words these belong to, and by the whole word so far, exactly, to PREFIX bytes. Their log-odds are added with weights; the gate that
chooses the weights is the bit's place in its byte, how often the word so far occurs and whether the contexts reach back to the word before. A map from
the mixed log-odds to what happened, by gate, refines the result. Every choice rests on what comes before a bit, so the probabilities of all words and
the end add up to one at most.

Learning: counts cover all training tokens. The weights learn online: each part of the vocabulary and of the heads takes gradient steps over its words, a
few thousand at a time, weighted by how often they occur, the counts of the word so far being those without one of its occurrences; the parts' weights are
averaged by what each gate has seen, and then the last map is counted.

What is coded once: the bits of a word from its byte HEAD on depend on the word alone, as no context is longer than HEAD + 1 bytes with the blank. The first HEAD
bytes depend on these and on the HEAD bytes that the text has before the blank: both together are the token's head. So each different word's rest and each
different head is coded once, and a text's score is the sum over its tokens, exactly what coding it byte by byte gives.

On Spark: words and heads are counted with map-side sums; the vocabulary is range-sorted into parts of about PART_WORDS, in which the counts of every prefix are
sums of neighbours; prefixes that go over a part's edge are completed from the profiles of the parts' first and last words, which
the driver adds up (at most 2 * 8 * PREFIX numbers a part). Heads are dealt to parts by hash. Broadcast are the hashed contexts (at most 2^16 + 3 * 2^(CONTEXT_BITS + 8) rows
whatever the corpus is; some 10^6 in practice), the counts of words' beginnings (at most 2^(8 * HEAD)) and the words and heads with more than one in HOT_WORDS of all tokens, fewer than
HOT_WORDS of each by their definition. Texts are read twice and never shuffled: frequent words and heads are added up in the scan, the others are joined by
their keys, none of them often enough to be a hot key.

Nulls: a null text is an end alone; a null doc_id is scored, not held out and not learned from. Repeated rows are learned and scored each. Without
training rows every bit is even. Very long texts are one vectorised step of a task; very long words are coded whole. Empty tables give no rows. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CONTEXT_BITS = 15
ORDERS = 4
#: Bytes of a word whose contexts reach back to the word before.
HEAD = ORDERS - 1
PREFIX = 32
PART_WORDS = 1 << 16
HOT_WORDS = 1 << 21
#: Half a count or so for what was never seen.
UNSEEN = 0.4
#: Gates: confidences of the word so far, by the places of a bit in its byte.
CONFIDENCES = 16
BINS = 33
RATE = 0.15
STEP_BYTES = 1 << 16
END = b"\n"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_IN_WORD = np.ones(256, bool)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
_END_KEY = common.span_hashes(np.frombuffer(END, np.uint8), np.array([0]), np.array([1]))


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word, its text, and the lower-case bytes."""
    data, at = common.raw(common.utf8(common.col(batch, "text")))
    low = _LOWER[data]
    starts, ends = common.word_spans(_IN_WORD[low], at)
    return common.span_hashes(low, starts, ends), starts, ends, np.searchsorted(at, starts, "right") - 1, low


def _heads(starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, low: np.ndarray, texts: int) -> np.ndarray:
    """The head of each word, then of each text's end: the HEAD bytes before its blank and its first HEAD bytes (blank included) as one number."""
    low, blank = low.astype(np.int64), 0x20
    size = ends - starts
    first = np.append(True, owner[1:] != owner[:-1])[: len(owner)]
    final = low[ends - 1]
    before = np.where(first, 0, np.roll(final, 1))
    second = np.where(size > 1, low[ends - np.minimum(size, 2)], blank)
    third = np.where(size > 2, low[ends - np.minimum(size, 3)], np.where(size > 1, blank, before))
    tail = third << 16 | second << 8 | final
    at = np.searchsorted(owner, np.arange(texts), "right")
    some = at > np.searchsorted(owner, np.arange(texts))
    last = np.zeros(texts, np.int64)
    last[some] = tail[at[some] - 1]
    own = low[starts] << 16 | np.where(size > 1, low[starts + np.minimum(size - 1, 1)], blank) << 8 | np.where(size > 2, low[starts + np.minimum(size - 1, 2)], np.where(size > 1, blank, 0))
    end = END[0] << 16 | blank << 8
    return np.append(np.where(first, 0, np.roll(tail, 1)) << 24 | own, last << 24 | end)


def vocabulary(documents: DataFrame, learn: Column) -> DataFrame:
    """key, word, n (how often in rows to learn from) and total (in all rows) of every token; the end is a word of its own.

    Heads have rows too: key is the head, word null.
    """
    common.small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = learned = 0
        for batch in common.slices(batches, limit=8 * common.SLICE_BYTES):
            keys, starts, ends, owner, low = _tokens(batch)
            flag = common.col(batch, "learn").to_numpy(zero_copy_only=False).astype(bool)
            texts, learned = texts + len(flag), learned + int(flag.sum())
            key, first, of, total = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
            n = np.bincount(of, flag[owner], len(key)).astype(np.int64)
            held = low.tobytes()
            word = pa.array([held[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), word, pa.array(n), pa.array(total)], names=["key", "word", "n", "total"])
            flag = np.append(flag[owner], flag)
            key, of, total = np.unique(_heads(starts, ends, owner, low, batch.num_rows), return_inverse=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.nulls(len(key), pa.binary()), pa.array(np.bincount(of, flag, len(key)).astype(np.int64)), pa.array(total)], names=["key", "word", "n", "total"])
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array(_END_KEY.view(np.int64)), pa.array([END], pa.binary()), pa.array([learned]), pa.array([texts])], names=["key", "word", "n", "total"])

    rows = documents.select("text", F.coalesce(learn, F.lit(False)).alias("learn")).mapInArrow(run, "key long, word binary, n long, total long")
    return rows.groupBy("key", "word").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


# ---- the bits of words ----------------------------------------------------------------------------------------------


class Words:
    """Some words (sorted bytes) as positions: each byte of a word, from skip on, and the blank after it."""

    def __init__(self, words: list[bytes], skip: int = 0):
        self.data = np.frombuffer(b"".join(b"\0\0\0 " + w + b" " for w in words), np.uint8)
        self._place(np.array([len(w) + 1 for w in words], np.int64), skip)

    def _place(self, lengths: np.ndarray, skip: int) -> None:
        starts = np.cumsum(lengths + 4) - lengths
        left = np.maximum(lengths - skip, 0)
        self.owner = np.repeat(np.arange(len(lengths)), left)
        self.at = np.arange(len(self.owner)) - (np.cumsum(left) - left)[self.owner] + skip
        self.place = starts[self.owner] + self.at
        self.byte = self.data[self.place]

    def contexts(self, order: int) -> np.ndarray:
        """Order, context and byte of each position as one number."""
        held = np.zeros(len(self.place), np.uint32)
        for k in range(order, 0, -1):
            held = held << np.uint32(8) | self.data[self.place - k]
        if order > 1:
            held = held * np.uint32(0x9E3779B1) >> np.uint32(32 - CONTEXT_BITS)
        return np.uint32(order - 1) << np.uint32(30) | held << np.uint32(8) | self.byte


class Heads(Words):
    """Some heads as positions: the first bytes of words after the last bytes of others."""

    def __init__(self, heads: np.ndarray):
        held = (heads[:, None] >> np.arange(40, -8, -8) & 255).astype(np.uint8)
        short = held[:, 4] == 0x20  # a word of one byte: its blank is the last byte
        rows = np.insert(held, HEAD, 0x20, 1)
        keep = np.ones(rows.shape, bool)
        keep[:, -1] = ~short
        self.data = rows[keep]
        self._place(np.where(short, HEAD - 1, HEAD), 0)


def _levels(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log-odds of the eight bits of each key's byte, from the counts of all keys (ascending, the byte lowest)."""
    out = np.zeros((len(keys), 8), np.float32)
    above = None
    for j in range(9):
        group = keys >> np.uint32(8 - j)
        head = np.flatnonzero(np.append(True, group[1:] != group[:-1])[: len(group)])
        sums = np.add.reduceat(n, head) if len(head) else n
        here = np.repeat(sums, np.diff(np.append(head, len(group))))
        if above is not None:
            out[:, j - 1] = np.log((here + UNSEEN) / (above - here + UNSEEN))
        above = here
    return out


def _bits_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading bits the rows of two byte matrices share."""
    differ = a ^ b
    some = differ.any(1)
    at = np.argmax(differ != 0, 1)
    high = 7 - np.floor(np.log2(np.maximum(differ[np.arange(len(a)), at], 1))).astype(np.int64)
    return np.where(some, at * 8 + high, 8 * a.shape[1])


def _matrix(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The first PREFIX bytes of each word and its blank, and how many bits these are."""
    cut = [(w + b" ")[:PREFIX] for w in words]
    return np.frombuffer(b"".join(w.ljust(PREFIX, b"\0") for w in cut), np.uint8).reshape(len(words), PREFIX), np.array([8 * len(w) for w in cut], np.int64)


def prefix_counts(words: list[bytes], n: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often the first 1, 2, ... bits of each word occur, over sorted words, one after another, and where each word's begin.

    left and right: what other parts add to the prefixes of the first and of the last word.
    """
    matrix, bits = _matrix(words)
    shared = np.append(-1, _bits_shared(matrix[1:], matrix[:-1]))
    offsets = np.append(0, np.cumsum(bits))
    out = np.zeros(offsets[-1], np.int64)
    active = np.arange(len(words))
    for k in range(1, int(bits.max(initial=0)) + 1):
        active = active[bits[active] >= k]
        head = np.flatnonzero(shared[active] < k)
        sums = np.add.reduceat(n[active], head)
        if active[0] == 0 and k <= len(left):
            sums[0] += left[k - 1]
        if active[-1] == len(words) - 1 and k <= len(right):
            sums[-1] += right[k - 1]
        out[offsets[active] + k - 1] = np.repeat(sums, np.diff(np.append(head, len(active))))
    return out, offsets


class Model:
    """What coding a word takes: contexts (keys, log-odds), profiles of the parts, weights by gate and the last map."""

    def __init__(self, keys: np.ndarray, odds: np.ndarray, total: int):
        self.keys, self.odds, self.total = keys, odds, total
        self.edges: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.begun = np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.skip = 0
        self.weights = np.full((2 * CONFIDENCES * 8, ORDERS + 1), 0.25, np.float64)
        self.map: np.ndarray | None = None

    def begins(self, heads: np.ndarray) -> np.ndarray:
        """How often the first 1, 2, ... bits of each head's word occur, heads one after another."""
        held, sums = self.begun
        word, of = np.unique(heads & 0xFFFFFF, return_inverse=True)
        left = np.arange(8 * HEAD - 1, -1, -1)
        low = word[:, None] >> left << left
        return (sums[np.searchsorted(held, low + (1 << left))] - sums[np.searchsorted(held, low)])[of].ravel()

    def part(self, part: int, words: list[bytes] | np.ndarray, n: np.ndarray, alone: bool = False) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """The words (or heads, an array) of a part by slices: their bits' log-odds by predictor, gate, value and owner.

        alone: the counts of the word so far are without one of the word's own occurrences.
        """
        heads = isinstance(words, np.ndarray)
        if heads:
            counts, offsets = None, None
            sizes = np.arange(1, len(words) + 1) * (HEAD + 1)
        else:
            counts, offsets = prefix_counts(words, n, *self.edges.get(part, (np.zeros(0, np.int64),) * 2))
            sizes = np.cumsum([len(w) + 1 for w in words])
        first = 0
        while first < len(words):
            last = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + STEP_BYTES)))
            some = Heads(words[first:last]) if heads else Words(words[first:last], self.skip)
            odds = np.zeros((len(some.byte), 8, ORDERS + 1), np.float32)
            for order in range(1, ORDERS + 1):
                odds[:, :, order - 1] = self.odds[np.searchsorted(self.keys, some.contexts(order))]
            gate = np.zeros((len(some.byte), 8), np.int64)
            inside = np.flatnonzero(some.at < PREFIX)
            if heads:
                held, begin = self.begins(words[first:last]), 8 * HEAD * some.owner[inside]
            else:
                held, begin = counts, offsets[first + some.owner[inside]]
            at = (begin + 8 * some.at[inside])[:, None] + np.arange(8)
            here = held[at]
            above = held[np.maximum(at - 1, 0)]
            above[some.at[inside] == 0, 0] = self.total
            own = np.minimum(n[first + some.owner[inside]], 1)[:, None] if alone else 0
            odds[inside, :, ORDERS] = np.log((here - own + UNSEEN) / (above - here + UNSEEN))
            gate[inside] = np.minimum(np.log2(np.maximum(above - own, 0) + 1).astype(np.int64), CONFIDENCES - 1)
            gate = (gate + CONFIDENCES * heads) * 8 + np.arange(8)
            value = np.unpackbits(some.byte[:, None], axis=1).astype(bool)
            yield slice(first, last), odds.reshape(-1, ORDERS + 1), gate.ravel(), value.ravel(), np.repeat(some.owner, 8)
            first = last

    def mixed(self, odds: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip(np.einsum("ij,ij->i", odds, self.weights[gate]), -20, 20)

    def learned(self, part: int, words: list[bytes] | np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The weights after a pass over the part's words, and how many bits each gate has seen."""
        w, grown, seen = self.weights.copy(), np.full(self.weights.shape, 1e-3), np.zeros(len(self.weights))
        for some, odds, gate, _, owner in self.part(part, words, n, True):
            much = n[some][owner].astype(np.float64)
            miss = much / (1 + np.exp(np.clip(np.einsum("ij,ij->i", odds, w[gate]), -20, 20)))
            held = np.bincount(gate, much, len(w))
            step = np.stack([np.bincount(gate, miss * odds[:, k], len(w)) for k in range(w.shape[1])], 1) / np.maximum(held, 1)[:, None]
            grown += step**2
            w += RATE * step / np.sqrt(grown)
            seen += held
        return w, seen

    def happened(self, part: int, words: list[bytes] | np.ndarray, n: np.ndarray) -> np.ndarray:
        """By confidence and bin of the log-odds of a 1: how many bits, and how many were 1."""
        out = np.zeros((2, 2 * CONFIDENCES * BINS))
        for some, odds, gate, value, owner in self.part(part, words, n, True):
            mixed = self.mixed(odds, gate)
            low, share = _bin(np.where(value, mixed, -mixed))
            much = n[some][owner].astype(np.float64)
            for bin_, part_of in ((low, 1 - share), (low + 1, share)):
                at = gate // 8 * BINS + bin_
                out[0] += np.bincount(at, much * part_of, out.shape[1])
                out[1] += np.bincount(at, much * part_of * value, out.shape[1])
        return out

    def log10(self, part: int, words: list[bytes] | np.ndarray, n: np.ndarray) -> np.ndarray:
        """The log10 probability of each word."""
        out = np.zeros(len(words))
        for some, odds, gate, value, owner in self.part(part, words, n):
            mixed = self.mixed(odds, gate)
            p = 1 / (1 + np.exp(-mixed))
            if self.map is not None:
                low, share = _bin(np.where(value, mixed, -mixed))
                at = gate // 8 * BINS + low
                one = (1 - share) * self.map[at] + share * self.map[at + 1]
                p = (p + np.where(value, one, 1 - one)) / 2
            out[some] = np.bincount(owner, np.log10(p), some.stop - some.start)
        return out


def _bin(odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bin at or below log-odds, of BINS from -8 to 8, and how far on to the next they are."""
    at = (np.clip(odds, -7.999, 7.999) + 8) * ((BINS - 1) / 16)
    low = at.astype(np.int64)
    return low, at - low


# ---- learning -------------------------------------------------------------------------------------------------------


def _sorted(t: pa.Table) -> tuple[int, list[bytes], np.ndarray, pa.Table]:
    t = t.sort_by("word")
    return t.column("part")[0].as_py(), t.column("word").to_pylist(), t.column("n").to_numpy(), t


def _mingled(t: pa.Table) -> tuple[int, np.ndarray, np.ndarray, pa.Table]:
    """A part of the heads, in an order that has nothing to do with their bytes."""
    t = t.take(pa.array(np.argsort(common.mixed(t.column("key").to_numpy().view(np.uint64)))))
    return t.column("part")[0].as_py(), t.column("key").to_numpy(), t.column("n").to_numpy(), t


def _completed(profiles: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By part: what the parts before add to the prefixes of its first word, and the parts after to those of its last."""
    profiles = sorted(profiles, key=lambda r: r.part)
    ends = _matrix([bytes(r[c]) for r in profiles for c in ("first", "last")])[0] if profiles else np.zeros((0, PREFIX), np.uint8)

    def shared(i: int, j: int) -> int:
        return int(_bits_shared(ends[i : i + 1], ends[j : j + 1])[0])

    out = {}
    for k, r in enumerate(profiles):
        sides = []
        for step, own, near, far, name, size in ((-1, 2 * k, 1, 0, "tail", len(r["head"])), (1, 2 * k + 1, 0, 1, "head", len(r["tail"]))):
            more, m, depth = np.zeros(size, np.int64), k + step, size
            while 0 <= m < len(profiles):
                depth = min(depth, shared(own, 2 * m + near))
                if not depth:
                    break
                more[:depth] += np.array(profiles[m][name][:depth], np.int64)
                depth = min(depth, shared(own, 2 * m + far))  # only what holds all of a part goes on to the next
                m += step
            sides.append(more)
        out[r.part] = (sides[0], sides[1])
    return out


def model(parts: DataFrame, heads: DataFrame | None = None) -> Model:
    """The model of a stored vocabulary (part, word, n) and its heads (part, key, n); without heads every word is a text of its own."""
    spark, skip = parts.sparkSession, 0 if heads is None else HEAD

    def contexts(t: pa.Table) -> pa.Table:
        _, words, n, _ = (_sorted if "word" in t.column_names else _mingled)(t)
        keys, sums = [], []
        for k in range(0, len(words), 1 << 14):
            held = words[k : k + (1 << 14)]
            some = Heads(held) if isinstance(held, np.ndarray) else Words(held, skip)
            for order in range(1, ORDERS + 1):
                key, of = np.unique(some.contexts(order), return_inverse=True)
                keys.append(key)
                sums.append(np.bincount(of, n[k + some.owner], len(key)).astype(np.int64))
        key, of = np.unique(np.concatenate(keys), return_inverse=True)
        return pa.table({"key": pa.array(key.astype(np.int64)), "n": pa.array(np.bincount(of, np.concatenate(sums), len(key)).astype(np.int64))})

    def of_all(run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
        """What run gives for the parts of the words and of the heads."""
        made = parts.groupBy("part").applyInArrow(run, schema)
        return made if heads is None else made.union(heads.groupBy("part").applyInArrow(run, schema))

    rows = of_all(contexts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    key, n = rows.column("key").to_numpy().astype(np.uint32), rows.column("n").to_numpy()
    order = np.argsort(key)
    made = Model(key[order], _levels(key[order], n[order]).astype(np.float16), int(parts.agg(F.sum("n")).first()[0] or 0))
    made.skip = skip
    if heads is not None:
        # at most 2^(8 * HEAD) rows whatever the corpus is
        begun = heads.groupBy(F.expr(f"key & {(1 << 8 * HEAD) - 1}").alias("word")).agg(F.sum("n").alias("n")).toArrow().sort_by("word")
        made.begun = begun.column("word").to_numpy(), np.append(0, np.cumsum(begun.column("n").to_numpy()))

    def profile(t: pa.Table) -> pa.Table:
        part, words, n, _ = _sorted(t)
        counts, offsets = prefix_counts(words, n, np.zeros(0, np.int64), np.zeros(0, np.int64))
        head, tail = counts[: offsets[1]], counts[offsets[-2] :]
        return pa.table({"part": pa.array([part], pa.int32()), "first": pa.array([words[0]], pa.binary()), "last": pa.array([words[-1]], pa.binary()), "head": pa.array([head], pa.list_(pa.int64())), "tail": pa.array([tail], pa.list_(pa.int64()))})

    # a row a part
    made.edges = _completed(parts.groupBy("part").applyInArrow(profile, "part int, first binary, last binary, head array<long>, tail array<long>").collect())

    def summed(kind: str, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Of all parts, the sums of two rows of numbers."""
        shared = spark.sparkContext.broadcast(made)

        def run(t: pa.Table) -> pa.Table:
            part, words, n, _ = (_sorted if "word" in t.column_names else _mingled)(t)
            if kind == "weights":
                w, seen = shared.value.learned(part, words, n)
                a, b = (w * seen[:, None]).ravel(), np.repeat(seen, w.shape[1])
            else:
                a, b = shared.value.happened(part, words, n)
            some = np.flatnonzero((a != 0) | (b != 0))  # what a part has not seen adds nothing
            return pa.table({"i": pa.array(some.astype(np.int32)), "a": pa.array(a[some]), "b": pa.array(b[some])})

        got = of_all(run, "i int, a double, b double").groupBy("i").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toArrow()
        out = np.zeros((2, width))
        for row, name in enumerate("ab"):
            out[row, got.column("i").to_numpy()] = got.column(name).to_numpy()
        return out[0], out[1]

    a, b = summed("weights", made.weights.size)
    made.weights = np.where(b > 0, a / np.maximum(b, 1), made.weights.ravel()).reshape(made.weights.shape)
    n, ones = summed("map", 2 * CONFIDENCES * BINS)
    even = 1 / (1 + np.exp(-(np.tile(np.arange(BINS), 2 * CONFIDENCES) * (16 / (BINS - 1)) - 8)))
    made.map = np.clip((ones + 30 * even) / (n + 30), 1e-6, 1 - 1e-6)
    return made


def scored(documents: DataFrame, learn: Column, part_words: int = PART_WORDS, hot_words: int = HOT_WORDS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score and n_bytes (coded ones) of each document.

    learn: which rows the model learns from.
    """
    spark = documents.sparkSession
    counted = common.stored(vocabulary(documents, learn), "scoring-words")
    words, heads = counted.where("word is not null"), counted.where("word is null").drop("word")
    seen = words.agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("v"), F.sum("total").alias("total"), F.count("*").alias("words")).first()
    tokens, all_tokens = int(seen.n or 0), int(seen.total or 0)
    ranged = words.select("key", "word", "n", "total").repartitionByRange(max(1, -(-seen.words // part_words)), "word")
    parts = common.stored(ranged.withColumn("part", F.spark_partition_id()), "scoring-parts")
    heads = heads.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(max(1, -(-heads.count() // part_words)))).cast("int"))
    made = spark.sparkContext.broadcast(model(parts.select("part", "word", "n"), heads.select("part", "key", "n")))
    down = np.log10(float(tokens + seen.v + 1))

    def coded(t: pa.Table) -> pa.Table:
        """Of a part's words what they add to the base score, and the costs of their bits from HEAD on; of heads the costs of theirs."""
        whole = "word" in t.column_names
        part, held, n, t = (_sorted if whole else _mingled)(t)
        cost = made.value.log10(part, held, n)
        base = np.log10(n + 1.0) - down if whole else np.zeros(len(n))
        return pa.table({"key": t.column("key"), "n": pa.array(n if whole else np.zeros(len(n), np.int64)), "total": t.column("total"), "base": pa.array(base), "cost": pa.array(cost)})

    schema = "key long, n long, total long, base double, cost double"
    costs = common.stored(parts.groupBy("part").applyInArrow(coded, schema).union(heads.groupBy("part").applyInArrow(coded, schema)), "scoring-costs")
    hot = F.col("total") > all_tokens / hot_words  # fewer than hot_words of either kind
    often = costs.where(hot).select("key", "n", "base", "cost").toArrow()
    key = often.column("key").to_numpy().view(np.uint64)
    order = np.argsort(key)
    table = [key[order], *(often.column(c).to_numpy()[order] for c in ("n", "base", "cost"))]
    shared = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, base, cost = shared.value
        for batch in common.slices(batches):
            keys, starts, ends, owner, low = _tokens(batch)
            heads = _heads(starts, ends, owner, low, batch.num_rows).view(np.uint64)
            owner = np.append(owner, np.arange(batch.num_rows))
            tokens = np.bincount(owner, minlength=batch.num_rows)
            keys = np.concatenate([keys, np.repeat(_END_KEY, batch.num_rows), heads])
            size = np.bincount(owner[: len(starts)], ends - starts + 1, batch.num_rows).astype(np.int64) + 2
            owner = np.append(owner, owner)
            at = np.minimum(np.searchsorted(key, keys), max(0, len(key) - 1))
            found = key[at] == keys if len(key) else np.zeros(len(keys), bool)
            own, at = owner[found], at[found]
            sums = [tokens, np.bincount(own, n[at] > 0, batch.num_rows).astype(np.int64), *(np.bincount(own, x[at], batch.num_rows).astype(np.float64) for x in (base, cost))]
            rare = np.flatnonzero(~found)
            rare = rare[np.argsort(owner[rare], kind="stable")]
            offsets = np.searchsorted(owner[rare], np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[rare].view(np.int64)))
            yield pa.RecordBatch.from_arrays([common.col(batch, "_row"), common.col(batch, "doc_id"), *(pa.array(x) for x in sums), pa.array(size), lists], names=["_row", "doc_id", "n_tokens", "n_known", "base_score", "score", "n_bytes", "rare"])

    rows = documents.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = common.stored(rows.mapInArrow(run, "_row long, doc_id long, n_tokens long, n_known long, base_score double, score double, n_bytes long, rare array<long>"), "scoring-rows")
    more = rows.select("_row", F.explode("rare").alias("key")).join(costs.where(~hot), "key")
    more = more.groupBy("_row").agg(F.count_if(F.col("n") > 0).alias("k"), F.sum("base").alias("b"), F.sum("cost").alias("c"))
    out = rows.drop("rare").join(more, "_row", "left")

    def plus(a: str, b: str) -> Column:
        return (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)

    return out.select("doc_id", "n_tokens", plus("n_known", "k"), F.lit(tokens).cast("long").alias("train_tokens"), plus("base_score", "b"), plus("score", "c"), "n_bytes")


def op12_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = common.crc_mod("doc_id", 7) == 2
    found = scored(common.table(spark, sf_dir, "documents"), ~held_out)
    bits = (-F.col("score") / F.lit(np.log10(2.0)) / F.col("n_bytes")).alias("bits_per_byte")
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", bits)
