"""SimHash near-duplicates: a binary trie over 64-bit fingerprints, joined with itself.

A fingerprint's bit is 1 if more than half of the hashes of the text's word shingles have it. Distinct fingerprints are the
leaves of a binary trie. The self-join walks pairs of trie nodes of one depth together, adds up the bits in which their paths
differ and drops a pair as soon as the sum exceeds the budget.

The distribution: two fingerprints within the budget are equal in one of BLOCKS (budget + 1) blocks of bits. For each block there is a trie
whose first bits are those of the block, and its walk allows no difference in them; so a fingerprint goes to BLOCKS groups of a Spark
shuffle, however many fingerprints there are. A group is a run of neighbouring values of a block, cut so that it holds about
NODE_FINGERPRINTS; a single value with more is dealt again by the node pairs of the next bits that are still within the budget. Below, the walk runs
inside the task over sorted arrays, where a node is a range. What decides the groups is a count per value of a block, at most
BLOCKS * 2^13 numbers whatever the corpus is.

A task does not return all pairs it finds but a spanning forest of them (at most one row per fingerprint, each a pair within the budget), so a large group of
near copies makes no square number of rows. The forests are joined by label exchange between the edges' ends (large star and
small star), each round written to the shared folder; nodes with very many edges are joined by broadcast (common.by_key).

The pipeline's stage has a rule of its own, five-word shingles at a Jaccard similarity of 0.8 or more. Its documents go through the same
trie self-join, with fingerprints of five-word shingles and STAGE_BUDGET bits, and its pairs are confirmed by the exact sets. Fingerprints of 64 bits miss
most pairs just above 0.8, so what the trie leaves apart is compared by bands and an exact join: see near_copies.

Nulls: a null text has no words; a null doc_id is kept with its fingerprint and never names a component (a component of null
ids only has a null component_id). Texts without words have fingerprint zero and are linked like any other. Repeated rows get
equal results. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHINGLE = 4
SEED = 42
BUDGET = 4
#: Fingerprints of a group, and into how many groups they are dealt at least (for parallel tasks).
NODE_FINGERPRINTS = 1 << 16
LEAST_GROUPS = 256
#: Levels by which one value of a block is dealt again at most (a node pair of 2^DEEPEST by 2^DEEPEST is then a group).
DEEPEST = 12
#: Bounds of one vectorised step of the walk.
LEAF = 16
STEP_PAIRS = 1 << 16


# ---- fingerprints ---------------------------------------------------------------------------------------------------


def _majority(hashes: np.ndarray) -> int:
    """Bits that more than half of the hashes have; the hashes are added in bit-sliced counters, 64 bits at a time."""
    n = len(hashes)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") if n <= 4096 else None
    if bits is not None:
        ones = bits.sum(0, dtype=np.int64)
    else:
        ones = np.zeros(64, np.int64)
        for k in range(0, n, 4096):
            ones += np.unpackbits(hashes[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprint(text: str | bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    data = text.encode() if isinstance(text, str) else text or b""
    words = data.lower().split()  # of bytes: A-Z only, and the six ASCII white spaces
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words])[: len(words) - shingle + 1].tolist()
    ends = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return _majority(np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends, strict=True)], np.uint64))


def fingerprints(documents: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of each document."""
    common.small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle, seed) for t in common.utf8(common.col(batch, "text"))]
            yield pa.RecordBatch.from_arrays([common.col(batch, "doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


# ---- the trie's self-join -------------------------------------------------------------------------------------------


class Forest:
    """Components of the pairs seen so far, by least index, and the pair that joined each index to a lesser one."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.pair = np.zeros((n, 2), np.int64)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            high, low = np.maximum(a, b), np.minimum(a, b)
            np.minimum.at(self.root, high, low)
            won = np.flatnonzero(self.root[high] == low)
            self.pair[high[won], 0], self.pair[high[won], 1] = i[won], j[won]
            self.root[:] = self.root[self.root]
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def linked(a: np.ndarray, b: np.ndarray | None, depth: int, spent: int, budget: int = BUDGET, exact: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Edges (i, j), each a pair within budget, of a spanning forest over all pairs within budget of two nodes at depth, or of one node (b is None).

    a and b are the nodes' sorted distinct fingerprints (uint64), spent the bits in which the nodes' paths differ. Of pairs that differ in
    the first exact bits none is needed, so the walk doesn't follow them. Indices count through a, then b.
    """
    both = a if b is None else np.concatenate([a, b])
    forest, base = Forest(len(both)), 0 if b is None else len(a)
    other = a if b is None else b
    one = np.uint64(1)
    stack = [(depth, np.array([[0, len(a), 0, len(other), spent]], np.int64))]

    def halves(values: np.ndarray, low: np.ndarray, high: np.ndarray, bit: np.uint64) -> np.ndarray:
        """Where the upper half of each node begins."""
        first = (values[low] >> bit | one) << bit
        return np.clip(np.searchsorted(values, first), low, high)

    def compare(nodes: np.ndarray) -> None:
        for k in range(0, len(nodes), 2048):
            part = nodes[k : k + 2048]
            wa, wb = int((part[:, 1] - part[:, 0]).max()), int((part[:, 3] - part[:, 2]).max())
            ia, ib = part[:, 0, None] + np.arange(wa), part[:, 2, None] + np.arange(wb)
            va, vb = both[np.minimum(ia, len(a) - 1)], other[np.minimum(ib, len(other) - 1)]
            near = np.bitwise_count(va[:, :, None] ^ vb[:, None, :]) <= budget
            near &= (ia < part[:, 1, None])[:, :, None] & (ib < part[:, 3, None])[:, None, :]
            n, x, y = np.nonzero(near)
            i, j = ia[n, x], ib[n, y] + base
            keep = i != j
            forest.add(i[keep], j[keep])

    while stack:
        depth, nodes = stack.pop()
        small = np.maximum(nodes[:, 1] - nodes[:, 0], nodes[:, 3] - nodes[:, 2]) <= LEAF
        if depth == 64:
            small[:] = True
        if small.any():
            compare(nodes[small])
            nodes = nodes[~small]
        if not len(nodes):
            continue
        if len(nodes) > STEP_PAIRS:
            stack += [(depth, nodes[k : k + STEP_PAIRS]) for k in range(0, len(nodes), STEP_PAIRS)]
            continue
        bit = np.uint64(63 - depth)
        ma, mb = halves(a, nodes[:, 0], nodes[:, 1], bit), halves(other, nodes[:, 2], nodes[:, 3], bit)
        lo_a, hi_a = (nodes[:, 0], ma), (ma, nodes[:, 1])
        lo_b, hi_b = (nodes[:, 2], mb), (mb, nodes[:, 3])
        below = []
        for (a0, a1), (b0, b1), more in ((lo_a, lo_b, 0), (hi_a, hi_b, 0), (lo_a, hi_b, 1), (hi_a, lo_b, 1)):
            err = nodes[:, 4] + more
            keep = (err <= (budget if depth >= exact else 0)) & (a1 > a0) & (b1 > b0)
            if b is None:
                keep &= a0 <= b0  # of a node's own pairs, each unordered pair once
            below.append(np.stack([a0, a1, b0, b1, err], 1)[keep])
        nxt = np.concatenate(below)
        if len(nxt):
            stack.append((depth + 1, nxt))
    child = np.flatnonzero(forest.root != np.arange(len(both)))
    return forest.pair[child, 0], forest.pair[child, 1]


def _blocks(budget: int) -> list[tuple[int, int]]:
    """First bit and width of each of budget + 1 blocks, the wider ones first."""
    n = budget + 1
    widths = [64 // n + (k < 64 % n) for k in range(n)]
    return [(sum(widths[:k]), w) for k, w in enumerate(widths)]


def _groups(counts: list[tuple[int, int, int]], at_most: int) -> list[tuple[int, int, int, int]]:
    """(block, value, group, levels) of each value of a block, from (block, value, n): neighbours share a group up to at_most."""
    out, group, held, last = [], -1, 0, None
    for block, value, n in sorted(counts):
        if block != last or held + n > at_most:
            group, held, last = group + 1, 0, block
        held += n
        out.append((block, value, group, min(DEEPEST, (n // at_most).bit_length() if n > at_most else 0)))
    return out


def edges(distinct: DataFrame, count: int, budget: int = BUDGET, at_most: int = NODE_FINGERPRINTS) -> DataFrame:
    """Links (u, v) between fingerprints within budget such that two are connected if and only if a chain within budget connects them.

    distinct: a stored table of the distinct fingerprints fp, count of them.
    """
    spark, blocks = distinct.sparkSession, _blocks(budget)
    at_most = max(2, min(at_most, -(-count * len(blocks) // LEAST_GROUPS)))
    turned = [f"struct({k} as block, shiftleft(fp, {first}) | shiftrightunsigned(fp, {(64 - first) % 64}) as turned)" if first else f"struct({k} as block, fp as turned)" for k, (first, _) in enumerate(blocks)]
    width = F.element_at(F.array(*[F.lit(w) for _, w in blocks]), F.col("block") + 1)
    dealt = distinct.select("fp", F.explode(F.expr(f"array({', '.join(turned)})")).alias("t")).select("t.block", "t.turned")
    dealt = dealt.withColumn("value", F.call_function("shiftrightunsigned", F.col("turned"), (64 - width).cast("int")).cast("int"))
    # at most (budget + 1) * 2^13 rows
    counts = [tuple(r) for r in dealt.groupBy("block", "value").agg(F.count("*").alias("n")).collect()]
    plan = spark.createDataFrame(_groups(counts, at_most), "block int, value int, group int, levels int")
    dealt = dealt.join(F.broadcast(plan), ["block", "value"])
    # the node of the next levels, and the nodes it meets
    below = F.call_function("shiftleft", F.col("turned"), width)
    node = F.when(F.col("levels") == 0, 0).otherwise(F.call_function("shiftrightunsigned", below, (64 - F.col("levels")).cast("int"))).cast("int")
    meets = F.when(F.col("levels") == 0, F.array(F.lit(0))).otherwise(F.expr(f"filter(sequence(0, shiftleft(1, levels) - 1), q -> bit_count(q ^ node) <= {budget})"))
    dealt = dealt.withColumn("node", node).withColumn("other", F.explode(meets))
    dealt = dealt.select("turned", "block", "group", "levels", F.when(F.col("levels") > 0, F.col("value")).alias("value"), F.least("node", "other").alias("low"), F.greatest("node", "other").alias("high"))

    def join(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        block, _, levels, _, low, high = (k.as_py() for k in key)
        first, width = blocks[block]
        fps = np.sort(t.column("turned").to_numpy().view(np.uint64))
        if low == high:
            at, other = linked(fps, None, width + levels if levels else 0, 0, budget, width)
        else:
            depth = width + levels
            shared = int(fps[0]) >> (64 - width)
            cut = int(np.searchsorted(fps, np.uint64((shared << levels | high) << (64 - depth))))
            if cut in (0, len(fps)):
                at = other = np.zeros(0, np.int64)
            else:
                at, other = linked(fps[:cut], fps[cut:], depth, (low ^ high).bit_count(), budget, width)
        back = fps >> np.uint64(first) | fps << np.uint64(64 - first) if first else fps
        back = back.view(np.int64)
        return pa.table({"u": back[at], "v": back[other]})

    return dealt.groupBy("block", "group", "levels", "value", "low", "high").applyInArrow(join, "u long, v long")


# ---- components -----------------------------------------------------------------------------------------------------


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """node, root for each node of the links (u, v): root is the least node of its component.

    Each round joins every edge with the least neighbour of one end: larger neighbours are moved to it (large star), then
    smaller ones (small star). The least neighbours are pre-aggregated before their shuffle and unique per node, and nodes with a
    large share of the edges are joined by broadcast. Rounds end when nothing changes, after a logarithmic number of them.
    """
    now = common.stored(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    before = None
    while True:
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sums[0] == 0 or tuple(sums) == before:
            break
        before = tuple(sums)
        # large star: every neighbour above a node goes to the least of the node and its neighbours
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")).where("n > 0")
        large = common.by_key(both.where("v > u"), common.stored(least, name), "u", sums[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = common.stored(large, name)
        # small star: a node and its lesser neighbours go to the least of these; a node with many of them is a hot key too
        least = common.stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), name)
        small = common.by_key(large, least, "u", large.count()).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        now = common.stored(small, name)
    # stars: every node points at its root
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, seed: int = SEED, budget: int = BUDGET) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links reach) of each document."""
    docs = common.stored(fingerprints(documents, shingle, seed), "fingerprints")
    distinct = common.stored(docs.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct-fingerprints")
    links = common.stored(edges(distinct.select("fp"), distinct.count(), budget), "links")
    rooted = common.stored(components(links).withColumnRenamed("node", "fp"), "roots")
    # a component's least id comes from its fingerprints' least ids; a fingerprint without links is its own
    held = rooted.join(distinct, "fp")
    least = held.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    linked_fps = common.by_key(held.select("fp", "root", F.col("n").alias("rows")), common.stored(least, "components-least"), "root", rooted.count())
    alone = distinct.join(rooted, "fp", "left_anti").select("fp", F.col("first").alias("component_id"), "n")
    of_fp = linked_fps.select("fp", "component_id", F.col("rows").alias("n")).unionByName(alone)
    of_fp = common.stored(of_fp, "components-of-fingerprints")
    return common.by_key(docs, of_fp, "fp", docs.count()).select("doc_id", "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


# ---- the pipeline's stage -------------------------------------------------------------------------------------------

#: Fixed values of the stage: near copies have a Jaccard similarity of SIMILAR or more over their sets of STAGE_SHINGLE-word shingles.
STAGE_SHINGLE = 5
SIMILAR = 0.8
#: Bits in which the stage's fingerprints may differ in the trie's self-join.
STAGE_BUDGET = 6
#: Bands of the min-hash signature and values in each: two texts of similarity s share a band with odds 1 - (1 - s^WIDTH)^BANDS.
BANDS = 20
WIDTH = 5
#: Members of a band's bucket that follow one, in the order of the next band's values, with which it is compared.
FOLLOWERS = 8
#: Rows of a band's bucket from which on it may be dealt to DEALS parts.
DEAL_ROWS = 4096
DEALS = 64
#: Bands of which the nearest follower is compared first; what that joins needs no other comparison.
FIRST_BANDS = 4

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_IN_WORD = np.ones(256, bool)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
_TURN = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * WIDTH), np.uint64) | np.uint64(1)


def shingle_sets(data: np.ndarray, at: np.ndarray, shingle: int = STAGE_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each document, as ascending hashes, and where each document's start (one more entry).

    A document of fewer words, but not none, has one shingle.
    """
    starts, ends = common.word_spans(_IN_WORD[data], at)
    words = common.span_hashes(_LOWER[data], starts, ends)
    owner = np.searchsorted(at, starts, "right") - 1
    docs = len(at) - 1
    h = np.zeros(len(words), np.uint64)
    for k in range(shingle):
        word = np.zeros(len(words), np.uint64)
        inside = owner[k:] == owner[: len(owner) - k]
        word[: len(inside)][inside] = words[k:][inside]
        h = common.mixed(h * np.uint64(0x9E3779B185EBCA87) + word)
    first = np.append(True, owner[1:] != owner[:-1])[: len(owner)]
    whole = np.zeros(len(words), bool)
    whole[: max(0, len(words) - shingle + 1)] = owner[shingle - 1 :] == owner[: max(0, len(owner) - shingle + 1)]
    keep = whole | first
    h, owner = h[keep], owner[keep]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    once = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))[: len(h)]
    return h[once], np.searchsorted(owner[once], np.arange(docs + 1))


def set_fingerprints(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bits that more than half of each document's distinct shingles have."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    ones = np.zeros((len(at) - 1, 64), np.int64)
    for k in range(0, len(h), 1 << 14):
        of = owner[k : k + (1 << 14)]
        heads = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        bits = np.unpackbits(h[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[of[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
    return np.packbits(ones * 2 > np.diff(at)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _sketches(documents: DataFrame) -> DataFrame:
    """_row, doc_id, same (a hash of the whole shingle set), fp and bands (key, tail) of each document; no bands without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            h, at = shingle_sets(*common.raw(common.utf8(common.col(batch, "text"))))
            full = np.flatnonzero(at[1:] > at[:-1])
            same = np.zeros(len(at) - 1, np.uint64)
            offsets = np.zeros(len(at), np.int32)
            keys = tails = np.zeros(0, np.uint64)
            if len(full):
                heads = at[full]
                same[full] = common.mixed(np.add.reduceat(common.mixed(h ^ np.uint64(SEED)), heads) + (at[full + 1] - heads).astype(np.uint64))
                least = np.stack([np.minimum.reduceat(((h ^ x) * y) >> np.uint64(32), heads) for x, y in _TURN.T]).reshape(BANDS, WIDTH, -1)
                key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], (BANDS, len(full)))
                for k in range(WIDTH):
                    key = common.mixed(key * np.uint64(0x9E3779B185EBCA87) + least[:, k])
                tail = np.roll(least, -1, 0)
                keys, tails = key.T.ravel(), (tail[:, 0] << np.uint64(32) | tail[:, 1]).T.ravel()
                offsets[full + 1] = BANDS
                offsets = np.cumsum(offsets, dtype=np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(keys.view(np.int64)), pa.array(tails.view(np.int64))], names=["key", "tail"])
            yield pa.RecordBatch.from_arrays([common.col(batch, "_row"), common.col(batch, "doc_id"), pa.array(same.view(np.int64)), pa.array(set_fingerprints(h, at).view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pairs)], names=["_row", "doc_id", "same", "fp", "bands"])

    return documents.select("_row", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "_row long, doc_id long, same long, fp long, bands array<struct<key:long,tail:long>>")


def trie_pairs(nodes: DataFrame) -> DataFrame:
    """u, v: candidates among nodes (same, fp) from the trie's self-join; of equal fingerprints each node with the least."""
    of_fp = common.stored(nodes.groupBy("fp").agg(F.min("same").alias("first")), "near-fingerprints")
    count = of_fp.count()
    links = common.stored(edges(of_fp.select("fp"), count, STAGE_BUDGET), "near-trie")

    def first(fp: str, name: str) -> DataFrame:
        some = of_fp.toDF(fp, name)
        return F.broadcast(some) if count <= common.BROADCAST_ROWS else some

    alike = nodes.select("same", "fp").join(first("fp", "first"), "fp").select("same", "first")
    near = links.join(first("u", "a"), "u").join(first("v", "b"), "v").select("a", "b")
    pairs = alike.union(near).toDF("u", "v").where("u <> v")
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _sets(texts: DataFrame) -> DataFrame:
    """same and its shingles, from (same, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            h, at = shingle_sets(*common.raw(common.utf8(common.col(batch, "text"))))
            yield pa.RecordBatch.from_arrays([common.col(batch, "same"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)))], names=["same", "shingles"])

    return texts.select("same", "text").mapInArrow(run, "same long, shingles array<long>")


def _dealt(banded: DataFrame, total: int) -> DataFrame:
    """banded with deal: the part of its bucket that a row is compared in. Buckets with a large share of all rows are dealt by the next band's values."""
    hot = common.stored(banded.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > max(total / common.HOT_KEYS, DEAL_ROWS)).select("key", F.lit(True).alias("hot")), "near-hot")
    # fewer than HOT_KEYS rows by their definition
    dealt = banded.join(F.broadcast(hot), "key", "left")
    return dealt.withColumn("deal", F.when(F.col("hot"), F.pmod(F.xxhash64("tail"), F.lit(DEALS))).otherwise(0)).drop("hot")


def _crowd(buckets: DataFrame, root: DataFrame) -> DataFrame:
    """same and root of the nodes in buckets of which not all pairs were compared and whose members aren't all of one component."""
    rows = buckets.join(root.select(F.col("node").alias("same"), "root"), "same", "left").withColumn("root", F.coalesce("root", "same"))
    apart = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    return rows.join(apart, "key", "left_semi").groupBy("same").agg(F.first("root").alias("root"))


def prefix_pairs(sets: DataFrame) -> DataFrame:
    """u, v: candidates among sets (same, root, shingles), with every pair of different roots whose similarity is SIMILAR or more.

    All sets are put in one order, rarest shingles first. Two sets x and y, y not the larger, of the similarity or more share at least
    need = SIMILAR / (1 + SIMILAR) * (|x| + |y|) shingles. The first shared one has need shingles from it on in both, so it's among the first
    |x| - need + 1 of x, where |y| is at least SIMILAR * |x|, and among the first |y| - need + 1 of y, where |x| is at least |y|. What a template
    gives to very many texts, unless it makes them similar, comes too late in y to be looked up, so such shingles join nothing.
    """
    held = sets.select("same", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("h"))
    often = held.groupBy("h").agg(F.count("*").alias("f"))
    ordered = held.join(often, "h").groupBy("same", "root", "n").agg(F.array_sort(F.collect_list(F.struct("f", "h"))).alias("o"))
    first = F.col("n") - F.ceil(F.lit(SIMILAR) * F.col("n") - 1e-9) + 1
    prefix = ordered.select("same", "root", "n", F.posexplode(F.slice("o", F.lit(1), first.cast("int"))).alias("at", "o")).where("o.f > 1")
    prefix = common.stored(prefix.select("same", "root", "n", "at", F.col("o.h").alias("h")), "near-prefixes")
    share = SIMILAR / (1 + SIMILAR)
    looked_up = prefix.where(F.col("at") <= F.col("n") - F.ceil(F.lit(2 * share) * F.col("n") - 1e-9))
    x = prefix.toDF(*(f"x_{c}" for c in prefix.columns))
    y = looked_up.toDF(*(f"y_{c}" for c in prefix.columns))
    need = F.ceil(F.lit(share) * (F.col("x_n") + F.col("y_n")) - 1e-9)
    smaller = (F.col("y_n") < F.col("x_n")) | ((F.col("y_n") == F.col("x_n")) & (F.col("y_same") < F.col("x_same")))
    near = (F.col("y_n") >= F.lit(SIMILAR) * F.col("x_n") - 1e-9) & (F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at")) >= need)
    met = x.join(y, (F.col("x_h") == F.col("y_h")) & (F.col("x_root") != F.col("y_root")) & smaller & near)
    return met.select(F.col("x_same").alias("u"), F.col("y_same").alias("v")).distinct()


def near_copies(documents: DataFrame) -> DataFrame:
    """_row, doc_id and group of each document (_row, doc_id, text): near copies, or chains of them, are of one group.

    Equal shingle sets are one node. Nodes first meet in the trie's self-join over their fingerprints; what its confirmed pairs join needs no other
    comparison. For what it leaves apart, nodes that share a band of their signatures are candidates: each with the FOLLOWERS after
    it in its bucket, so a large bucket makes no square number of rows. Candidates are confirmed by the exact similarity of
    their shingle sets, in equi-joins. A bucket with more members has pairs that were not compared; unless all of its members are of one
    component by then, they go through an exact join by prefixes (prefix_pairs). Documents without words are equal.
    """
    common.small_batches(documents.sparkSession)
    rows = common.stored(_sketches(documents), "near-sketches")
    nodes = common.stored(rows.where("size(bands) > 0").groupBy("same").agg(F.min("_row").alias("_row"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "near-nodes")
    tried = common.stored(trie_pairs(nodes), "near-tried")
    banded = nodes.select("same", F.posexplode("bands").alias("band", "b")).select("same", "band", "b.key", "b.tail")
    bucket = Window.partitionBy("key", "deal")
    after = bucket.orderBy("tail", "same").rowsBetween(1, FOLLOWERS)
    met = _dealt(banded, nodes.count() * BANDS).withColumn("next", F.collect_list("same").over(after)).withColumn("n", F.count("*").over(bucket)).where((F.col("n") > 1) | (F.col("deal") > 0))
    met = common.stored(met.select("same", "band", "key", "n", "deal", "next"), "near-buckets")
    followed = met.select("same", "band", F.posexplode("next").alias("nth", "other"))
    soon = (F.col("nth") == 0) & (F.col("band") < FIRST_BANDS)
    pairs = common.stored(followed.groupBy(F.least("same", "other").alias("u"), F.greatest("same", "other").alias("v")).agg(F.max(soon).alias("soon")), "near-pairs")
    named = met.select("same").union(tried.select("u")).union(tried.select("v")).distinct()
    held = common.stored(named.join(nodes.select("same", "_row"), "same"), "near-held")
    # their texts are found by row number, without a shuffle of texts while there are few enough
    texts = documents.select("_row", "text").join(F.broadcast(held) if held.count() <= common.BROADCAST_ROWS else held, "_row")
    sets = common.stored(_sets(texts), "near-sets")

    def confirmed(some: DataFrame) -> DataFrame:
        left = sets.select(F.col("same").alias("u"), F.col("shingles").alias("a"))
        right = sets.select(F.col("same").alias("v"), F.col("shingles").alias("b"))
        shared = F.size(F.array_intersect("a", "b"))
        return some.join(left, "u").join(right, "v").where(shared / (F.size("a") + F.size("b") - shared) >= SIMILAR).select("u", "v")

    def joined(root: DataFrame, some: DataFrame) -> DataFrame:
        # what earlier links joined goes on as stars, so that only the further links take rounds
        stars = root.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
        return common.stored(components(stars.union(common.stored(confirmed(some), "near-links"))), "near-roots")

    def apart(root: DataFrame, some: DataFrame) -> DataFrame:
        of = [root.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in ("u", "v")]
        return some.join(of[0], "u", "left").join(of[1], "v", "left").where(F.coalesce("root_u", "u") != F.coalesce("root_v", "v")).select("u", "v")

    root = common.stored(components(common.stored(confirmed(tried), "near-links")), "near-roots")
    for some in (pairs.where("soon"), pairs.where("not soon")):
        root = joined(root, apart(root, some))
    large = met.where((F.col("n") > FOLLOWERS + 1) | (F.col("deal") > 0)).select("same", "key")
    crowd = common.stored(_crowd(large, root), "near-crowd")
    if crowd.count():
        root = joined(root, prefix_pairs(sets.join(crowd, "same")))
    root = root.withColumnRenamed("node", "same")
    of_same = rows.groupBy("same").agg(F.count("*").alias("n")).join(root, "same", "left").select("same", F.coalesce("root", "same").alias("group"), "n")
    return common.by_key(rows.select("_row", "doc_id", "same"), common.stored(of_same, "near-groups"), "same", rows.count()).select("_row", "doc_id", "group")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies the first row by doc_id (nulls last) stays.

    Rows decide, not ids: different texts of one doc_id, or of none, are each kept or dropped by their own group.
    """
    row = common.free_name(docs, "row")
    rows = common.stored(docs.withColumn(row, F.monotonically_increasing_id()), "near-rows")
    groups = common.stored(near_copies(rows.select(F.col(row).alias("_row"), "doc_id", "text")), "near-rows-of-groups")
    kept = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("k")).select(F.col("k._row").alias("_row"))
    dropped = common.stored(groups.select("_row").join(kept, "_row", "left_anti").toDF(row), "near-dropped")
    return common.matched(rows, dropped, row, "left_anti").select(docs.columns)
