"""Context-mixing scores against plain counting and plain coding of single bits."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetgrain.llm import common, scoring

SCHEMA = "doc_id long, text string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = " \t\n\x0b\x0c\r"


def words_of(text):
    out = [""]
    for c in (text or "").translate(LOW):
        out = [*out, ""] if c in SPACE else [*out[:-1], out[-1] + c]
    return [w.encode() for w in out if w]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    syllables = ["an", "be", "The", "or", "ü", "so", "1", "—", "ti"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 5)))
    known = [word() for _ in range(150)]
    text = lambda: "".join(rng.choice(known) + rng.choice([" ", "\n", "\t "]) if rng.random() < 0.9 else word() + " " for _ in range(rng.randint(0, 80)))
    return [*((i, text()) for i in range(200)), (None, text()), (7, None), (8, "  "), (9, "x" * 100 + " " + "x" * 70), *[(3, "the same text")] * 30]


def test_base_scores_equal_plain_counting(spark, rows):
    docs = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", key int")
    learn = F.col("doc_id") % 3 != 0
    counts = Counter()
    for i, text in rows:
        if i is not None and i % 3:
            counts.update([*words_of(text), b"\n"])
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, text in rows:
        tokens = [*words_of(text), b"\n"]
        want.append((i, len(tokens), sum(counts[t] > 0 for t in tokens), n, round(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens), 6)))
    for hot in (1 << 21, 40):  # with every word broadcast, and with most of them joined
        got = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in scoring.scored(docs, learn, hot_words=hot).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_joined_words_score_as_broadcast_ones(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    learn = F.col("doc_id") % 3 != 0
    one, two = (sorted((r.n_tokens, round(r.score, 6)) for r in scoring.scored(docs, learn, hot_words=h).collect()) for h in (1 << 21, 40))
    assert one == two and all(s < 0 for _, s in one)


def bits_of(data):
    return "".join(f"{b:08b}" for b in data)


def test_prefix_counts_over_parts_equal_plain_counting():
    rng = random.Random(2)
    words = sorted({bytes(rng.choice(b"ab\xc3") for _ in range(rng.randint(1, 40))) for _ in range(300)} | {b"a" * k for k in range(1, 40)})
    n = np.array([rng.randint(0, 9) for _ in words])
    strings = [bits_of((w + b" ")[: scoring.PREFIX]) for w in words]
    cuts = [0, 3, 4, 5, 90, 91, 200, len(words)]
    spans = list(zip(cuts, cuts[1:]))
    from pyspark.sql import Row

    profiles = []
    for part, (a, b) in enumerate(spans):
        counts, at = scoring.prefix_counts(words[a:b], n[a:b], np.zeros(0, np.int64), np.zeros(0, np.int64))
        profiles.append(Row(part=part, first=words[a], last=words[b - 1], head=counts[: at[1]].tolist(), tail=counts[at[-2] :].tolist()))
    edges = scoring._completed(profiles)
    for part, (a, b) in enumerate(spans):
        counts, at = scoring.prefix_counts(words[a:b], n[a:b], *edges[part])
        for i in range(a, b):
            want = [sum(m for m, s in zip(n, strings) if s[:k] == strings[i][:k]) for k in range(1, len(strings[i]) + 1)]
            assert counts[at[i - a] : at[i - a + 1]].tolist() == want


def learned(spark, words, n):
    parts = spark.createDataFrame([(i * 3 // len(words), w, m) for i, (w, m) in enumerate(zip(words, n))], "part int, word binary, n long")
    return scoring.model(common.stored(parts, "test")), [(p, [w for i, w in enumerate(words) if i * 3 // len(words) == p], np.array([m for i, m in enumerate(n) if i * 3 // len(words) == p])) for p in range(3)]


def test_coding_equals_a_plain_coder(spark):
    rng = random.Random(4)
    words = sorted({bytes(rng.choice(b"abc\xc3") for _ in range(rng.randint(1, 6))) for _ in range(120)} | {b"\n", b"a" * 50})
    n = [rng.choice([0, 1, 2, 30]) for _ in words]
    made, parts = learned(spark, words, n)
    tables = [Counter() for _ in range(scoring.ORDERS)]

    def context(order, data, at):
        h = int.from_bytes(data[at - order : at], "big")
        return h if order == 1 else (h * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - scoring.CONTEXT_BITS

    spelled = [b"\0\0\0 " + w + b" " for w in words]
    for data, m in zip(spelled, n):
        for at in range(4, len(data)):
            for order in range(1, scoring.ORDERS + 1):
                for j in range(9):
                    tables[order - 1][context(order, data, at), bits_of(data[at : at + 1])[:j]] += m
    strings = [bits_of((w + b" ")[: scoring.PREFIX]) for w in words]
    under = lambda s: sum(m for m, t in zip(n, strings) if t.startswith(s))
    got = np.concatenate([made.log10(*p) for p in parts])
    for w in rng.sample(range(len(words)), 12):
        total = 0.0
        for at in range(4, len(spelled[w])):
            byte = bits_of(spelled[w][at : at + 1])
            for j in range(8):
                odds, seen = [], 0
                for order in range(1, scoring.ORDERS + 1):
                    c = context(order, spelled[w], at)
                    here, above = tables[order - 1][c, byte[: j + 1]], tables[order - 1][c, byte[:j]]
                    odds.append(np.float64(np.float16(np.float32(math.log((here + 0.4) / (above - here + 0.4))))))
                if at - 4 < scoring.PREFIX:
                    s = bits_of(spelled[w][4:at]) + byte[:j]
                    seen, here = under(s), under(s + byte[j])
                    odds.append(np.float64(np.float32(math.log((here + 0.4) / (seen - here + 0.4)))))
                else:
                    odds.append(0.0)
                gate = min(int(math.log2(seen + 1)), scoring.CONFIDENCES - 1)
                x = float(np.dot(made.weights[gate * 8 + j], odds))
                p, x = 1 / (1 + math.exp(-x)), x if byte[j] == "1" else -x
                place = (min(max(x, -7.999), 7.999) + 8) * (scoring.BINS - 1) / 16
                low = int(place)
                one = (1 - place + low) * made.map[gate * scoring.BINS + low] + (place - low) * made.map[gate * scoring.BINS + low + 1]
                total += math.log10((p + (one if byte[j] == "1" else 1 - one)) / 2)
        assert got[w] == pytest.approx(total, rel=1e-4)


def test_first_bytes_add_up_to_one(spark):
    words = [bytes([b]) for b in range(256)]
    n = [b % 7 for b in range(256)]
    made, parts = learned(spark, words, n)
    total = 0.0
    for p in parts:
        for some, odds, gate, value, owner in made.part(*p):
            x = made.mixed(odds, gate)
            low, share = scoring._bin(np.where(value, x, -x))
            at = gate // 8 * scoring.BINS + low
            one = (1 - share) * made.map[at] + share * made.map[at + 1]
            q = (1 / (1 + np.exp(-x)) + np.where(value, one, 1 - one)) / 2
            total += np.prod(q.reshape(-1, 2, 8)[:, 0], 1).sum()
    assert total == pytest.approx(1, abs=1e-6)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert scoring.scored(empty, F.lit(True)).count() == 0
    (r,) = scoring.scored(spark.createDataFrame([(1, "a b")], SCHEMA), F.lit(False)).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)
    assert r.score == pytest.approx(6 * 8 * math.log10(0.5)) and r.n_bytes == 6
    long = spark.createDataFrame([(1, "lorem ipsum " * 900_000), (2, "y" * 3_000_000)], SCHEMA)
    got = {r.doc_id: r for r in scoring.scored(long, F.lit(True)).collect()}
    assert got[1].n_tokens == 1_800_001 and got[2].n_tokens == 2 and got[2].score < 0


def test_held_out_texts_of_the_table(spark, small):
    got = scoring.op12_scoring(spark, small).where("held_out").agg(F.sum("score").alias("s"), F.sum("n_tokens").alias("n"), F.avg("bits_per_byte").alias("b")).first()
    assert got.n > 0 and got.b < 3.2  # bytes alone take some 4.3 bits


def test_texts_equal_a_plain_coder_across_words(spark):
    """A bit's contexts reach over the blank into the words before; each text is coded as one string of bytes."""
    rng = random.Random(6)
    known = ["".join(rng.choice("abü") for _ in range(rng.randint(1, 5))) for _ in range(40)]
    texts = [" ".join(rng.choice(known) for _ in range(rng.randint(0, 25))) for _ in range(60)] + ["a b", "b a", "", "\x00 \x00a", "ab" * 30 + " a"]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    learn = F.col("doc_id") % 3 != 0
    got = {r.doc_id: r.score for r in scoring.scored(docs, learn).collect()}
    for hot in (40, 1):  # with joined heads
        assert {r.doc_id: pytest.approx(r.score) for r in scoring.scored(docs, learn, hot_words=hot).collect()} == got
    held = common.stored(scoring.vocabulary(docs, learn).withColumn("part", F.lit(0)), "test")
    made = scoring.model(held.where("word is not null").select("part", "word", "n"), held.where("word is null").select("part", "key", "n"))

    streams = [b"\0\0\0 " + b"".join(w + b" " for w in [*words_of(t), b"\n"]) for t in texts]
    begins = [[4 + sum(len(w) + 1 for w in [*words_of(t), b"\n"][:k]) for k in range(len(words_of(t)) + 1)] for t in texts]
    tables, begun = [Counter() for _ in range(scoring.ORDERS)], Counter()

    def context(order, data, at):
        h = int.from_bytes(data[at - order : at], "big")
        return h if order == 1 else (h * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - scoring.CONTEXT_BITS

    for i, data in enumerate(streams):
        if i % 3 == 0:
            continue
        for at in range(4, len(data)):
            for order in range(1, scoring.ORDERS + 1):
                for j in range(9):
                    tables[order - 1][context(order, data, at), bits_of(data[at : at + 1])[:j]] += 1
        for a, b in zip(begins[i], [*begins[i][1:], len(data)]):
            word = bits_of(data[a : min(b, a + scoring.PREFIX)])
            begun.update(word[:k] for k in range(len(word) + 1))
    for i in [*range(0, 60, 7), *range(60, len(texts))]:
        data, total = streams[i], 0.0
        for at in range(4, len(data)):
            first = max(b for b in begins[i] if b <= at)
            byte = bits_of(data[at : at + 1])
            for j in range(8):
                odds, seen = [], 0
                for order in range(1, scoring.ORDERS + 1):
                    c = context(order, data, at)
                    here, above = tables[order - 1][c, byte[: j + 1]], tables[order - 1][c, byte[:j]]
                    odds.append(np.float64(np.float16(np.float32(math.log((here + 0.4) / (above - here + 0.4))))))
                if at - first < scoring.PREFIX:
                    s = bits_of(data[first:at]) + byte[:j]
                    seen, here = begun[s], begun[s + byte[j]]
                    odds.append(np.float64(np.float32(math.log((here + 0.4) / (seen - here + 0.4)))))
                else:
                    odds.append(0.0)
                gate = min(int(math.log2(seen + 1)), scoring.CONFIDENCES - 1) + scoring.CONFIDENCES * (at - first < scoring.HEAD)
                x = float(np.dot(made.weights[gate * 8 + j], odds))
                p, x = 1 / (1 + math.exp(-x)), x if byte[j] == "1" else -x
                place = (min(max(x, -7.999), 7.999) + 8) * (scoring.BINS - 1) / 16
                low = int(place)
                one = (1 - place + low) * made.map[gate * scoring.BINS + low] + (place - low) * made.map[gate * scoring.BINS + low + 1]
                total += math.log10((p + (one if byte[j] == "1" else 1 - one)) / 2)
        assert got[i] == pytest.approx(total, rel=1e-4)
    assert abs(got[60] - got[61]) > 1e-3  # the same words in another order
