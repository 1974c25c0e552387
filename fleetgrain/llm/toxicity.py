"""Toxicity by class-conditional Kneser-Ney bigram models.

Two models, of toxic and of ordinary texts, share their last backoff. P(w | v) of a class is its discounted bigram count over the
counts of v, then its Kneser-Ney unigram (in how many different left contexts w stands in the class), then the shared distribution: how
often w occurs in the whole corpus, labelled or not. A text's evidence is the difference of its two log-likelihoods, toxic less
ordinary, divided by its length.

The discount of a count n is DISCOUNT * sqrt(n), what it may owe to chance, and EXPECTED times what the shared counts already explain: of a word's
contexts the part that its share of the corpus is of its share of the class, of a bigram its share among those of v in the corpus, or what the
class's unigram expects. What is discounted goes to the backoff. So a class keeps
only what it says clearly more often than everyone; common words, a language that one class has more of, and passages that many documents
share give both classes the same probability up to a constant, and so no evidence.

A logistic curve over the evidence (and over it times the root of the length, which says how sure the mean is) makes it a score. It is fitted by
cross-fitting: the counts are also kept without each of FOLDS folds of the labelled rows, and a row's evidence comes from the
model without its fold. No label is given away: the model that scores has them all.

Learning: labelled rows come in as (doc_id, toxic). Of each class at most ``class_rows`` (the least by a hash of doc_id) are
read, a bound that keeps the broadcast model small; the curve brings the odds back to those of all labels. The shared counts cover every
document. All counting is Spark aggregation; words are 64-bit hashes. A count
that the discount takes whole (DISCOUNT squared or less, in both classes) leaves nothing in the model, so such bigrams and words need no
row; all others are held, in sorted arrays. For a word without a row the shared estimate is the same factor in both classes and cancels.

Nulls: a null or wordless text has length 0 and the score of no evidence; null labels are not learned from; a null doc_id is
scored but never learned from. Repeated rows are scored alike. Without labels of both classes every score is the share of toxic
labels (0 without any). Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CLASS_ROWS = 6000
DISCOUNT = 1.5
EXPECTED = 1.5
FOLDS = 4
_WORDS = common.word_table(b"'")
_START = np.uint64(0x5AFE)


def _hashed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bigrams of each text, each once: hash of the word, of the word before it (_START at the text's start), and the text.

    Repeated lines so count once, in learning and in scoring.
    """
    data, at = common.raw(common.utf8(common.col(batch, "text")))
    low = _WORDS[data]
    starts, ends = common.word_spans(low > 0, at)
    words = common.span_hashes(low, starts, ends)
    owner = np.searchsorted(at, starts, "right") - 1
    before = np.empty_like(words)
    if len(words):
        before[0] = _START
        before[1:] = words[:-1]
        before[1:][owner[1:] != owner[:-1]] = _START
        _, once = np.unique(common.mixed(_pair_hash(before, words) + owner.astype(np.uint64)), return_index=True)
        once.sort()
        words, before, owner = words[once], before[once], owner[once]
    return words, before, owner


def _place(keys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of keys stands in the ascending of, and whether it does."""
    if not len(of):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(of, keys), len(of) - 1)
    return at, of[at] == keys


def _shared_counts(documents: DataFrame, keys: list[np.ndarray]) -> tuple[list[np.ndarray], float]:
    """How often each of keys (ascending hashes of words, of words before and of bigrams) occurs, a bigram of a document once; and all."""
    known = documents.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = [np.zeros(len(k), np.int64) for k in known.value], 0
        for batch in common.slices(batches):
            words, before, _ = _hashed(batch)
            total += len(words)
            for of, n, got in zip(known.value, counts, (words, before, _pair_hash(before, words)), strict=True):
                at, has = _place(got, of)
                n += np.bincount(at[has], minlength=len(of))
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([0], pa.int32()), pa.array([total], pa.int64())], names=["kind", "place", "n"])
        for kind, n in enumerate(counts):
            places = np.flatnonzero(n)
            for k in range(0, len(places), 1 << 16):
                s = places[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), kind, np.int32)), pa.array(s.astype(np.int32)), pa.array(n[s])], names=["kind", "place", "n"])

    rows = documents.select("text").mapInArrow(run, "kind int, place int, n long").groupBy("kind", "place").agg(F.sum("n").alias("n")).toArrow()
    kind, place, n = (rows.column(c).to_numpy() for c in ("kind", "place", "n"))
    out = [np.zeros(len(k)) for k in keys]
    for k, counts in enumerate(out):
        counts[place[kind == k]] = n[kind == k]
    return out, float(max(1, n[kind == -1].sum()))


def _bigrams(sample: DataFrame) -> DataFrame:
    """kind (1 toxic, 0 not), v, w and counts n0 (of all texts) and n1 to nFOLDS (of those not in fold 0 to FOLDS - 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            words, before, owner = _hashed(batch)
            if len(words):
                toxic, fold = (common.col(batch, c).to_numpy(zero_copy_only=False)[owner].astype(np.int32) for c in ("toxic", "fold"))
                yield pa.RecordBatch.from_arrays([pa.array(toxic), pa.array(fold), pa.array(before.view(np.int64)), pa.array(words.view(np.int64))], names=["kind", "fold", "v", "w"])

    rows = sample.select("text", "toxic", "fold").mapInArrow(run, "kind int, fold int, v long, w long")
    without = [F.count_if(F.col("fold") != f).alias(f"n{f + 1}") for f in range(FOLDS)]
    return rows.groupBy("kind", "v", "w").agg(F.count("*").alias("n0"), *without)


class Counts:
    """What all models share: keys in ascending order, the corpus's counts of them, and each model's counts of both classes."""

    def __init__(self, bigrams: DataFrame, documents: DataFrame, discount: float = DISCOUNT):
        grams = common.stored(bigrams, "toxicity-bigrams")
        models = range(FOLDS + 1)
        sums = [x for j in models for x in (F.count_if(F.col(f"n{j}") > 0).alias(f"t{j}"), F.sum(f"n{j}").alias(f"s{j}"))]
        whole = {r.kind: r for r in grams.groupBy("kind").agg(*sums).collect()}
        #: Of each model and class: how many different bigrams, and how many.
        self.types, self.tokens = (np.array([[whole[k][f"{x}{j}"] if k in whole else 0 for k in (0, 1)] for j in models], float) for x in "ts")
        if not self.types[0].all():
            return
        each = [(j, k) for j in models for k in (0, 1)]
        per = [F.sum(F.when(F.col("kind") == k, F.col(f"n{j}")).otherwise(0)).alias(f"c{j}_{k}") for j, k in each]
        contexts = [F.count_if((F.col("kind") == k) & (F.col(f"n{j}") > 0)).alias(f"c{j}_{k}") for j, k in each]
        holds = F.greatest("c0_0", "c0_1") > discount**2

        def of(rows: pa.Table, keys: np.ndarray, all_keys: np.ndarray, name: str = "c") -> np.ndarray:
            out = np.zeros((FOLDS + 1, 2, len(all_keys)), np.float32)
            at = np.searchsorted(all_keys, keys)
            for j, k in each:
                out[j, k, at] = rows.column(f"{name}{j}_{k}").to_numpy()
            return out

        pairs = common.stored(grams.groupBy("v", "w").agg(*per).where(holds), "toxicity-pairs")
        rows = pairs.toArrow()
        v, w = (rows.column(c).to_numpy().view(np.uint64) for c in ("v", "w"))
        key = _pair_hash(v, w)
        order = np.argsort(key)
        self.pair_key, self.pair_v, self.pair_w = key[order], v[order], w[order]
        self.pairs = of(rows, key, self.pair_key)
        rows = grams.join(pairs.select("v").distinct(), "v").groupBy("v").agg(*per).toArrow()
        found = rows.column("v").to_numpy().view(np.uint64)
        self.left_key = np.sort(found)
        self.lefts = of(rows, found, self.left_key)
        often = [F.sum(F.when(F.col("kind") == k, F.col(f"n{j}")).otherwise(0)).alias(f"i{j}_{k}") for j, k in each]
        rows = grams.groupBy("w").agg(*contexts, *often).where(holds).toArrow()
        found = rows.column("w").to_numpy().view(np.uint64)
        self.word_key = np.union1d(found, w)
        self.contexts, self.often = of(rows, found, self.word_key), of(rows, found, self.word_key, "i")
        (self.shared, self.shared_lefts, self.shared_pairs), self.total = _shared_counts(documents, [self.word_key, self.left_key, self.pair_key])


class Model:
    """One model's probabilities, by ascending key; row 0 of a pair is the ordinary class, row 1 the toxic one."""

    def __init__(self, counts: Counts, which: int = 0, discount: float = DISCOUNT, expected: float = EXPECTED):
        self.word_key, self.left_key, self.pair_key = counts.word_key, counts.left_key, counts.pair_key
        types = np.maximum(counts.types[which], 1)[:, None]
        shared = np.maximum(counts.shared, 1) / counts.total
        n = counts.contexts[which]
        own = np.maximum(counts.often[which], 1) / np.maximum(counts.tokens[which], 1)[:, None]
        held = np.maximum(n - discount * np.sqrt(n) - expected * n * shared / own, 0) / types
        #: What the discount leaves to the shared distribution.
        self.spare = 1 - held.sum(1)
        self.words = held + self.spare[:, None] * shared
        v, w = (_place(got, of)[0] for got, of in ((counts.pair_v, self.left_key), (counts.pair_w, self.word_key)))
        after = counts.shared_pairs / np.maximum(counts.shared_lefts[v], 1) if len(v) else np.zeros(0)
        n, lefts = counts.pairs[which], np.maximum(counts.lefts[which], 1)
        held = np.maximum(n - discount * np.sqrt(n) - expected * lefts[:, v] * np.maximum(after, self.words[:, w]), 0) / lefts[:, v] if len(v) else np.zeros((2, 0))
        self.pairs = held
        self.rest = np.ones(lefts.shape)
        for k in (0, 1):
            np.subtract.at(self.rest[k], v, held[k])

    def evidence(self, words: np.ndarray, before: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """Mean log-likelihood difference (toxic less ordinary) and length of each text."""

        def found(table: np.ndarray, place: tuple[np.ndarray, np.ndarray], other: float) -> np.ndarray:
            return np.where(place[1], table[place[0]], other) if len(table) else np.full(len(words), other)

        ws, vs, ps = _place(words, self.word_key), _place(before, self.left_key), _place(_pair_hash(before, words), self.pair_key)
        logs = []
        for k in (0, 1):
            unigram = found(self.words[k], ws, self.spare[k])  # of a word without a row, up to its shared probability
            logs.append(np.log(found(self.pairs[k], ps, 0.0) + found(self.rest[k], vs, 1.0) * unigram))
        n = np.bincount(owner, minlength=texts)
        return np.bincount(owner, logs[1] - logs[0], texts) / np.maximum(n, 1), n


def _score(curve: np.ndarray, mean: np.ndarray, n: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_features(mean, n) @ curve, -50, 50)))


def _pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """As Spark's xxhash64(v, w) of two longs: seed 42, then the hash so far as seed."""
    out = np.full(len(v), 42, np.uint64)
    for x in (v, w):
        out = _xxh_long(x, out)
    return out


def _xxh_long(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    # fixed values: the primes of XXH64
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turn(a: np.ndarray, k: int) -> np.ndarray:
        return a << np.uint64(k) | a >> np.uint64(64 - k)

    h = seed + p5 + np.uint64(8)
    h ^= turn(x * p2, 31) * p1
    h = turn(h, 27) * p1 + p4
    h ^= h >> np.uint64(33)
    h *= p2
    h ^= h >> np.uint64(29)
    h *= p3
    return h ^ h >> np.uint64(32)


def _features(mean: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(mean)), np.clip(mean, -0.2, 0.2) * 50, np.clip(mean * np.sqrt(n), -5, 5)], 1)


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton steps; the first column of x is the constant."""
    b, penalty = np.zeros(x.shape[1]), ridge * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(b)), x.T @ (y - p) - penalty @ b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


def learn(documents: DataFrame, labels: DataFrame, class_rows: int = CLASS_ROWS) -> Learned | float:
    """The model of documents (doc_id, text) by labels (doc_id, toxic); without labels of both classes, the share of toxic ones."""
    common.small_batches(documents.sparkSession)
    given = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64(F.col("doc_id"), F.lit("toxicity"))
    total = given.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    chosen = [given.where(F.col("toxic") == k).withColumn("_order", order).orderBy("_order").limit(class_rows) for k in (0, 1)]
    chosen = common.stored(chosen[0].unionByName(chosen[1]), "toxicity-rows")
    share = (total.t or 0) / total.n if total.n else 0.0
    if share in (0.0, 1.0):
        return share
    # at most 2 * class_rows ids: a bounded side
    chosen = F.broadcast(chosen.select("doc_id", "toxic", F.pmod("_order", F.lit(FOLDS)).cast("int").alias("fold")))
    sample = common.stored(documents.select("doc_id", "text").join(chosen, "doc_id").dropDuplicates(["toxic", "text"]), "toxicity-sample")
    counts = Counts(_bigrams(sample), documents)
    if not counts.types[0].all():
        return share
    model = Learned(Model(counts))
    rows = _crossed(sample, [Model(counts, f + 1) for f in range(FOLDS)]).toArrow()
    mean, n, y = (rows.column(c).to_numpy() for c in ("mean", "n", "toxic"))
    # a class beyond class_rows is cut, so the sample's odds are brought back to those of all labels
    model.curve = fit_curve(_features(mean, n), y.astype(float))
    model.curve[0] += math.log(share / (1 - share) / (y.mean() / (1 - y.mean())))
    model.shipped = documents.sparkSession.sparkContext.broadcast(model.model)
    return model


class Learned:
    """A model, the curve that makes its evidence a score, and the model as a broadcast variable."""

    def __init__(self, model: Model):
        self.model, self.curve, self.shipped = model, np.zeros(3), None


def _crossed(sample: DataFrame, models: list[Model]) -> DataFrame:
    """mean, n and toxic of the sample's texts, each by the model without its fold."""
    shared = sample.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            hashed, fold = _hashed(batch), common.col(batch, "fold").to_numpy()
            each = [m.evidence(*hashed, batch.num_rows) for m in shared.value]
            mean = np.choose(fold, [m for m, _ in each])
            yield pa.RecordBatch.from_arrays([pa.array(mean), pa.array(each[0][1]), common.col(batch, "toxic")], names=["mean", "n", "toxic"])

    return sample.select("text", "fold", "toxic").mapInArrow(run, "mean double, n long, toxic int")


def evidence(documents: DataFrame, model: Learned, keep: list[str]) -> DataFrame:
    """keep, with mean, n and score: the mean log-likelihood difference and the words of each text."""
    shared, curve = model.shipped, model.curve
    fields = [f for f in documents.select(*keep).schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", mean double, n long, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in common.slices(batches):
            mean, n = m.evidence(*_hashed(batch), batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(common.col(batch, c) for c in keep), pa.array(mean), pa.array(n), pa.array(_score(curve, mean, n))], names=[*keep, "mean", "n", "score"])

    return documents.select(*keep, "text").mapInArrow(run, schema)


def scores(documents: DataFrame, labels: DataFrame, class_rows: int = CLASS_ROWS) -> DataFrame:
    """doc_id and score of each document, by a model learned from the labels given."""
    model = learn(documents, labels, class_rows)
    if isinstance(model, float):
        return documents.select("doc_id", F.lit(model).alias("score"))
    return evidence(documents, model, ["doc_id"]).select("doc_id", "score")


def _learned_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.table(spark, sf_dir, "labels").where(common.crc_mod("doc_id", 5) != 0).select("doc_id", "toxic")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scores(common.table(spark, sf_dir, "documents"), _learned_labels(spark, sf_dir))
    return found.select("doc_id", F.coalesce(common.crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def ordinary(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that are not scored as toxic."""
    model = learn(docs, _learned_labels(spark, sf_dir))
    if isinstance(model, float):
        return docs if model < 0.5 else docs.limit(0)
    return _filtered(docs, model)


def _filtered(docs: DataFrame, model: Learned) -> DataFrame:
    shared, curve = model.shipped, model.curve

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in common.slices(batches):
            mean, n = m.evidence(*_hashed(batch), batch.num_rows)
            yield batch.filter(pa.array(_score(curve, mean, n) < 0.5))

    return docs.mapInArrow(run, docs.schema)
