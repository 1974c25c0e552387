"""The ten operators and the pipeline: brute force, SQL, round trips, held-out accuracy, and odd rows."""

import base64
import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from fleetgrain.llm import common, decontamination, flac, language, mixing, pii, queries, quotes, simhash, tokens, toxicity, warc

from ..compare import agree

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, kind string, size string, place string"
ODD = [
    (1, None, None, None, None, 1, "x", "s", "p"),
    (2, "", "en", "a", 0, 2, None, "s", "p"),
    (None, "no id here 12345", "en", "b", 1, 3, "x", None, "p"),
    (3, "the same text again and again", "en", "a", 1, 4, "x", "s", None),
    (3, "the same text again and again", "en", "a", 1, 4, "x", "s", None),
    (4, "Zürich \t\r\n 日本語 😀 " * 3000, "de", "a", 1, 5, "x", "s", "p"),
    (5, "!!! ... 123", "fr", None, 1, 6, "x", "s", "p"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, small):
    return [(r.doc_id, r.text) for r in common.table(spark, small, "documents").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, small, name):
    agree(queries.QUERIES[name](spark, small), queries.ORACLES[name], small)


# ---- 1


def test_toxic_words_are_learned(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]

    def text(bad):
        w = [rng.choice(words) for _ in range(60)]
        return " ".join(w + (["vileword", "nastyword"] if bad else [])) if not bad else " ".join(x for i, x in enumerate(w) for x in ([x, "vileword"] if i % 15 == 7 else [x, "nastyword"] if i % 15 == 14 else [x]))

    rows = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.scores(df.drop("toxic"), df.where("doc_id < 800").select("doc_id", "toxic")).collect()
    right = [(r.score >= 0.5) == (r.doc_id % 4 == 0) for r in got if r.doc_id >= 800]
    assert sum(right) / len(right) > 0.97


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(2, 0), (3, 1), (4, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.scores(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in toxicity.scores(odd, labels.limit(0)).collect()} == {0.0}
    assert toxicity.scores(none, labels).count() == 0


def test_scores_equal_brute_force_kneser_ney(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(3000)]  # many more than the model holds
    some = [f"common{k}" for k in range(30)]

    def text(toxic):
        out = [rng.choice(words) if rng.random() < 0.5 else rng.choice(some) for _ in range(150)]
        for k in range(0, 150, 30):
            out[k : k + 2] = ["bad", rng.choice(["thing", "one"])] if toxic and rng.random() < 0.7 else out[k : k + 2]
        return " ".join(out + ["a", "passage", "of", "many"] * (rng.random() < 0.5))

    rows = [(i, text(i % 5 == 0), int(i % 5 == 0)) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").cache()
    # some rows have no label, but all are in the shared counts
    model = toxicity.learn(df.drop("toxic"), df.where("doc_id < 600").select("doc_id", "toxic"))
    grams, shared = [{}, {}], {}
    for d, text_, toxic in rows:
        w = text_.split()
        for p in set(zip([None, *w], w)):
            shared[p] = shared.get(p, 0) + 1
            if d < 600:
                grams[toxic][p] = grams[toxic].get(p, 0) + 1
    total = sum(shared.values())
    of_word, of_left = {}, {}
    for (v, x), c in shared.items():
        of_word[x], of_left[v] = of_word.get(x, 0) + c, of_left.get(v, 0) + c
    uni, bi, rest = ([{}, {}] for _ in range(3))
    for k in (0, 1):
        contexts, lefts, often, n = {}, {}, {}, len(grams[k])
        for (v, x), c in grams[k].items():
            contexts[x], lefts[v], often[x] = contexts.get(x, 0) + 1, lefts.get(v, 0) + c, often.get(x, 0) + c
        own = {x: c / sum(often.values()) for x, c in often.items()}
        held = {x: max(c - 1.5 * c**0.5 - 1.5 * c * of_word[x] / total / own[x], 0) / n for x, c in contexts.items()}
        spare = 1 - sum(held.values())
        uni[k] = {x: held.get(x, 0) + spare * c / total for x, c in of_word.items()}
        for (v, x), c in grams[k].items():
            bi[k][v, x] = max(c - 1.5 * c**0.5 - 1.5 * lefts[v] * max(shared[v, x] / of_left[v], uni[k][x]), 0) / lefts[v]
            rest[k][v] = rest[k].get(v, 1) - bi[k][v, x]
    assert any(bi[1].values()) and uni[1]["bad"] > 2 * uni[0]["bad"]
    got = {r.doc_id: r["mean"] for r in toxicity.evidence(df, model, ["doc_id"]).collect()}
    for d, text_, _ in rows[:100] + rows[-50:]:
        w = text_.split()
        pairs = set(zip([None, *w], w))
        logs = [sum(np.log(bi[k].get((v, x), 0) + rest[k].get(v, 1) * uni[k][x]) for v, x in pairs) for k in (0, 1)]
        assert got[d] == pytest.approx((logs[1] - logs[0]) / len(pairs), abs=1e-5)


def test_toxicity_of_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    got = toxicity.op1_toxicity(spark, d).join(common.table(spark, d, "labels").select("doc_id", "toxic"), "doc_id").where("held_out and toxic is not null").collect()
    assert sum(r.predicted for r in got if r.toxic) >= 0.5 * sum(r.toxic for r in got)
    assert not any(r.predicted for r in got if not r.toxic)


def test_pair_hash_is_sparks(spark):
    rng = np.random.default_rng(0)
    v, w = (rng.integers(-(2**63), 2**63, 50) for _ in range(2))
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(v, w, strict=True)], "v long, w long")
    assert [r[0] for r in df.select(F.xxhash64("v", "w")).collect()] == toxicity._pair_hash(v.view(np.uint64), w.view(np.uint64)).view(np.int64).tolist()


# ---- 2


def _brute_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def _components(ids, fps):
    f = simhash.Forest(len(fps))
    x = np.array(fps, np.uint64)
    i, j = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4, 1))
    f.add(i, j)
    least = {}
    for d, r in zip(ids, f.root.tolist(), strict=True):
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [least.get(r) for r in f.root.tolist()]


def test_simhash_equals_brute_force(spark, small, docs):
    fps = [_brute_fingerprint(t) for _, t in docs]
    want = {d: (f"{f:016x}", c) for (d, _), f, c in zip(docs, fps, _components([d for d, _ in docs], fps), strict=True)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op2_simhash(spark, small).collect()}
    assert got == want


@pytest.mark.parametrize("at_most", [5, 40, 1 << 16])
def test_edges_connect_what_is_within_the_budget(spark, at_most):
    rng = np.random.default_rng(at_most)
    base = [int(b) for b in rng.integers(0, 2**64, 60, dtype=np.uint64)]
    base += [base[0] & ~(2**50 - 1) | int(b) for b in rng.integers(0, 2**50, 60, dtype=np.uint64)]  # a hot value of the first block
    near = [b ^ sum(1 << int(k) for k in set(rng.integers(0, 64, rng.integers(1, 6)).tolist())) for b in base for _ in range(4)]
    x = np.unique(np.array([*base, *near, 0, 2**64 - 1], np.uint64))
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    place = {int(v): k for k, v in enumerate(x.view(np.int64))}
    got = simhash.edges(df, len(x), at_most=at_most).collect()
    f, g = simhash.Forest(len(x)), simhash.Forest(len(x))
    f.add(np.array([place[r.u] for r in got]), np.array([place[r.v] for r in got]))
    g.add(*np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4, 1)))
    assert (f.root == g.root).all()


@pytest.mark.parametrize("leaf", [1, 16])
def test_trie_join_finds_every_link(monkeypatch, leaf):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    rng = np.random.default_rng(leaf)
    base = [int(b) for b in rng.integers(0, 2**64, 150, dtype=np.uint64)]
    near = [b ^ sum(1 << int(k) for k in set(rng.integers(0, 64, rng.integers(1, 5)).tolist())) for b in base for _ in range(6)]
    x = np.unique(np.array(base + near, np.uint64))
    f = simhash.Forest(len(x))
    cut = int(np.searchsorted(x, np.uint64(1 << 63)))
    for at, root, first in ((*simhash.linked(x[:cut], None, 1, 0), 0), (*simhash.linked(x[cut:], None, 1, 0), cut), (*simhash.linked(x[:cut], x[cut:], 1, 1), 0)):
        f.add(at + first, root + first)
    g = simhash.Forest(len(x))
    g.add(*np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4, 1)))
    assert (f.root == g.root).all()


def test_components_of_a_long_chain(spark):
    got = simhash.components(spark.range(0, 200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))).collect()
    assert {r.node: r.root for r in got} == dict.fromkeys(range(201), 0)


def test_simhash_of_odd_rows(odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    assert {(r.fp, r.component_id) for r in got if r.doc_id in (1, 2)} == {(0, 1)}
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.one_of_each_group(odd.sparkSession, odd, "")
    # rows decide: the one without an id has a text of its own; those without words are equal
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "5", "None"]


def _shingled(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stage_joins_near_copies_of_five_word_shingles(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(60):
        w = ["".join(rng.choice("abcdef") for _ in range(6)) for _ in range(rng.randint(60, 200))]
        texts.append(" ".join(w))
        for cut in (0.03, 0.1, 0.11, 0.3):  # a head of other words
            k = int(len(w) * cut)
            texts.append(" ".join([f"x{rng.random()}" for _ in range(k)] + w[k:]))
    sets = [_shingled(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    f = simhash.Forest(len(sets))
    f.add(*np.array(pairs).T)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = simhash.one_of_each_group(spark, rows, "").collect()
    assert len(pairs) > 200 and sorted(r.doc_id for r in kept) == sorted(set(f.root.tolist()))


def test_trie_returns_pairs_within_the_budget():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 20, np.uint64)
    x = np.unique(np.concatenate([base ^ sum((np.uint64(1) << np.uint64(b) for b in rng.choice(64, k, False)), np.uint64(0)) for k in range(7) for _ in range(8)]))
    i, j = simhash.linked(x, None, 0, 0)
    assert len(i) > 100 and (np.bitwise_count(x[i] ^ x[j]) <= simhash.BUDGET).all()


def test_set_fingerprints_equal_plain_counting():
    h = np.random.default_rng(5).integers(0, 1 << 63, 40_000, np.uint64) * np.uint64(2) + np.uint64(1)
    at = np.array([0, 0, 1, 3, 90, 39_000, 39_000, 40_000])
    want = [sum((2 * int((h[a:b] >> np.uint64(k) & np.uint64(1)).sum()) > b - a) << k for k in range(64)) for a, b in zip(at.tolist(), at[1:].tolist())]
    assert simhash.set_fingerprints(h, at).tolist() == want


def test_stage_joins_by_the_trie(spark, monkeypatch):
    """Near copies meet in the trie's self-join, without any band."""
    rng = random.Random(9)
    texts = []
    for _ in range(20):
        w = ["".join(rng.choice("abcdef") for _ in range(6)) for _ in range(300)]
        texts += [" ".join(w), " ".join(["x", *w[1:]]), " ".join([*w, "y"])]
    monkeypatch.setattr(simhash, "_dealt", lambda banded, total: banded.limit(0).withColumn("deal", F.lit(0)))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.one_of_each_group(spark, rows, "").collect()) == list(range(0, 60, 3))


# ---- 3


def test_quotes_are_linked_and_removed(spark):
    rows = [(1, 0, "Hello  there\nfriend"), (1, 1, "> hello there\n> Friend\nHi!\nHow are you"), (1, 2, ">> Hello there\n>> friend\n> Hi!\n> how are YOU\nfine"), (2, 0, "> hi! how are you\nwhat"), (2, 5, None), (2, 6, ""), (3, 0, "> nothing known"), (None, None, "> fine\nx"), (None, None, "> fine\nx")]
    df = spark.createDataFrame([(*r, "u", 1) for r in rows], "conv_id long, turn long, text string, role string, n_quotes int")
    got = {(r.conv_id, r.turn): (r.text, r.reply_to_conv, r.reply_to_turn, r.n_quotes, r.n_linked) for r in quotes.linked(df).collect()}
    assert got[1, 2] == ("fine", 1, 0, 2, 2) and got[1, 1] == ("Hi!\nHow are you", 1, 0, 1, 1) and got[2, 0] == ("what", 1, 1, 1, 1)
    assert got[2, 5] == (None, None, None, 0, 0) and got[2, 6] == ("", 2, 5, 0, 0) and got[3, 0] == ("", None, None, 1, 0)
    assert got[None, None][:3] == ("x", 1, 2) and quotes.linked(df).count() == len(rows)
    assert quotes.linked(df.limit(0)).count() == 0


def _brute_links(rows):
    """(conv, turn) -> (parent, n_quotes, n_linked) of messages (conv, turn, text), unique and without nulls."""
    norm = lambda x: " ".join(re.split("[ \t\r\n]+", x)).strip(" ").lower()
    units, quotes = {}, {}
    for c, t, text in rows:
        cut = [(len(re.sub("[^>]", "", (re.match(r"(?:[ \t]*>)+", x) or [""])[0])), re.sub(r"^(?:[ \t]*>)+", "", x)) for x in text.split("\n")]
        runs = []
        for k, (level, body) in enumerate(cut):
            if not k or cut[k - 1][0] != level:
                runs.append((level, []))
            runs[-1][1].append(body)
        for place, (level, lines) in enumerate(runs):
            whole, ones = norm(" ".join(lines)), [norm(x) for x in lines if norm(x)]
            if whole and level == 0:
                for u in {whole, *ones}:
                    units.setdefault(u, []).append((c, t))
            elif whole:
                quotes.setdefault((c, t), []).append([whole, *ones])
    ids, out = {(c, t) for c, t, _ in rows}, {}
    for c, t in ids:
        targets = []
        for passage in quotes.get((c, t), []):
            found = None
            for u in passage:
                near = [m for m in units.get(u, []) if m[0] == c and m[1] < t]
                far = min(units.get(u, [(c, t)]))
                found = found or (max(near) if near else far if far < (c, t) else None)
            targets.append(found)
        linked = [x for x in targets if x]
        out[c, t] = (linked[0] if linked else (c, t - 1) if (c, t - 1) in ids else None, len(targets), len(linked))
    return out


def test_quotes_equal_brute_force(spark):
    rng = random.Random(13)
    words = [rng.choice("abcdefg") * rng.randint(1, 3) for _ in range(30)]
    made, rows = [], []
    for c in range(40):
        for t in range(rng.randint(1, 12) if c else 60):
            if rng.random() < 0.1:
                continue
            lines = []
            for _ in range(rng.randint(0, 2)):  # quotes of parts, of what comes later too, and nested ones
                if made and rng.random() < 0.8:
                    of = rng.choice(made)
                    a = rng.randrange(len(of))
                    lines += [f"{rng.choice(['> ', '>', '>> ', ' > > '])}{x.upper()}  " for x in of[a : a + rng.randint(1, 3)]]
                lines.append(" ".join(rng.choices(words, k=rng.randint(1, 3))))
            own = [" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(rng.randint(1, 4))]
            made.append(own)
            rows.append((c, t, "\n".join(lines + own)))
    rng.shuffle(rows)
    want = _brute_links(rows)
    names = ("to", "_c", "_t", "_bc", "_bt", "key", "found", "id", "hash", "a.b")
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string").withColumns({n: F.lit(1) for n in names})
    got = quotes.linked(df)
    assert set(names) <= set(got.columns)
    got = {(r.conv_id, r.turn): r for r in got.collect()}
    assert sum(n for _, n, _ in want.values()) > 100
    for m, (parent, n, k) in want.items():
        r = got[m]
        assert ((r.reply_to_conv, r.reply_to_turn) if r.reply_to_conv is not None else None, r.n_quotes, r.n_linked) == (parent, n, k)
        assert parent is None or parent < m
        root, depth = m, 0
        while want[root][0]:
            root, depth = want[root][0], depth + 1
        assert (r.thread_conv, r.thread_turn, r.reply_depth) == (*root, depth)


def test_quotes_use_no_python(spark, small):
    plan = quotes.op3_quotes(spark, small)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- 4


def test_languages_of_held_out_texts(spark, small):
    d = "/root/testdata/sf0.01"
    got = language.op4_language(spark, d).join(common.table(spark, d, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.98


def test_mixed_languages_are_spans(spark):
    en, de = "the cat and the dog went with them to that other house ", "der hund und die katze sind nicht mit dem kind gegangen "
    ru = "собака и кошка пошли домой вместе "
    rows = [(i, (en, de, ru)[i % 3] * (i % 5 + 1), ("en", "de", "ru")[i % 3]) for i in range(60)]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = language.labelled(spark.createDataFrame([(1, en + de + ru)], "doc_id long, text string"), model, spans=True).first()
    assert [s.lang for s in got.spans] == ["en", "de", "ru"]


def _best_path_score(scores, path=None, switch=3.0):
    """The score of path, or of the best one by the plain recurrence."""
    if path is not None:
        return sum(scores[t, k] - (switch if t and path[t - 1] != k else 0) for t, k in enumerate(path))
    best = scores[0].copy()
    for row in scores[1:]:
        best = np.array([max(b - (switch if j != k else 0) for j, b in enumerate(best)) for k in range(len(row))]) + row
    return best.max()


@pytest.mark.parametrize("few", [0, 2, 100])
def test_paths_equal_plain_viterbi(monkeypatch, few):
    monkeypatch.setattr(language, "FEW", few)
    rng = np.random.default_rng(few)
    lengths = [1, 2, 40, 300, 7, 301]
    scores = (rng.normal(0, 3, (sum(lengths), 5)) + np.repeat(rng.normal(0, 1, (sum(lengths) // 20 + 1, 5)), 20, 0)[: sum(lengths)]).astype(np.float32)
    path = language.best_paths(scores, np.repeat(np.arange(len(lengths)), lengths))
    at = 0
    for n in lengths:
        part = scores[at : at + n].astype(float)
        assert _best_path_score(part, path[at : at + n]) == pytest.approx(_best_path_score(part), abs=1e-6)
        at += n
    monkeypatch.setattr(language, "FEW", 8)
    assert (language.best_paths(scores, np.repeat(np.arange(len(lengths)), lengths)) == path).all()


def test_long_texts_are_labelled_in_linear_time():
    rows = pa.table({"text": ["the cat and the dog " * 60_000], "letters": [True], "doc_id": [1]})
    model = language.Model(["a", "b"], *[(np.array([5, 5]), np.array([0, 1]), np.array([1, 1]))] * 2, np.ones((len(language.SCRIPTS), 2)))
    began = time.time()
    assert len(model.path(language.Words(rows.to_batches()[0]))) == 300_000 and time.time() - began < 4


def test_languages_of_odd_rows(odd, none):
    got = {r.doc_id: r for r in language.labelled(odd, language.learn(odd)).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[5].lang_pred == "und" and got[3].lang_pred == "en"
    assert {r.lang_pred for r in language.labelled(odd, language.learn(none)).collect()} == {"und"}


# ---- 5


def test_warc_round_trip(spark):
    rows = [(3, "u3", "same"), (1, "u1", "same"), (2, None, None), (5, "u\r\n5", ""), (7, "u7", "ünï"), (7, "u8", "ünï"), (None, "n", "same"), (None, "m", "lone")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, kind string")
    path = common.fresh_path(spark, "warc-test")
    files = warc.write_warc(pages, path, roll_bytes=300)
    got = warc.read_warc(files, path, payloads=True).collect()
    assert len(got) == len(rows) and files.count() > 1
    for r in got:
        if r.record_type == "response":
            assert base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode() == r.payload_digest
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to) for r in got)
    assert kinds == sorted([("1", "response", None), ("3", "revisit", 1), ("2", "response", None), ("5", "revisit", 2), ("7", "response", None), ("7", "revisit", 7), ("None", "revisit", 1), ("None", "response", None)])
    assert warc.read_warc(warc.write_warc(pages.limit(0), common.fresh_path(spark, "warc-test")), path).count() == 0


def test_warc_files_depend_on_the_pages_alone(spark):
    rng = random.Random(12)
    texts = ["".join(rng.choice("abcdefgh <>") for _ in range(rng.randint(500, 5000))) for _ in range(300)]
    rows = [(rng.randint(0, 3000) if rng.random() < 0.9 else None, f"http://h/{rng.randint(0, 9)}", rng.choice(texts)) for _ in range(4000)]
    schema = "page_id long, url string, html string"
    made = []
    for shuffled, parts, tasks in ((rows, 3, "4"), (sorted(rows, key=lambda r: r[2]), 11, "7")):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
        path = common.fresh_path(spark, "warc-test")
        files = warc.write_warc(spark.createDataFrame(shuffled, schema).repartition(parts), path, roll_bytes=100_000, range_bytes=1 << 20)
        spark.conf.set("spark.sql.shuffle.partitions", before)
        made.append(sorted(tuple(r) for r in files.select("name", "bytes", "sha256", "records").collect()))
    assert made[0] == made[1] and len(made[0]) > 10
    read = warc.read_warc(files, path)
    assert read.rdd.getNumPartitions() == len(made[0]) and read.count() == len(rows)
    with_payload = warc.read_warc(files, path, payloads=True).where("record_type = 'response'")
    assert with_payload.count() == len({t for _, _, t in rows})
    ids = re.findall(rb"WARC-Record-ID: (\S+)", b"".join(m for n, _, _, _ in made[0] for m in _members_of(path, n)))
    assert len(set(ids)) == len(rows)
    refers = re.findall(rb"WARC-Refers-To: (\S+)", b"".join(m for n, _, _, _ in made[0] for m in _members_of(path, n)))
    assert set(refers) <= set(ids) and len(refers) == len(rows) - len({t for _, _, t in rows})


def _members_of(path, name):
    import gzip

    with gzip.open(f"{path.removeprefix('file://')}/{name}") as f:
        yield f.read()


# ---- 6


def test_flac_round_trip():
    rng = random.Random(2)
    payloads = [flac.padded(b""), flac.padded(b"abc" * 1000), bytes(rng.randrange(256) for _ in range(576 * 3)), bytes(576), bytes([0, 255] * 288), bytes(int(128 + 100 * np.sin(i / 9)) for i in range(576 * 300))]
    streams = flac.encode(payloads)
    assert [d.tobytes() for d in flac.decode(streams)] == payloads
    assert len(streams[-1]) < len(payloads[-1]) / 2
    total, digest, points, at = flac._metadata(streams[1])
    assert flac.decode([streams[1][:4] + b"\x80" + streams[1][5:42] + streams[1][at:]])[0].tobytes() == payloads[1]  # frame by frame
    for k in (-1, -100, 60):
        bad = bytearray(streams[-1])
        bad[k] ^= 4
        with pytest.raises(ValueError):
            flac.decode([bytes(bad)])


def test_media_of_odd_rows(spark, odd, none):
    got = flac.pcm_blocks(flac.media(odd)).collect()
    assert len(got) == len(ODD)
    for r in got:
        whole = b"".join(bytes(b.pcm) for b in r.blocks)
        assert [b.sample_offset for b in r.blocks] == list(range(0, len(whole), flac.BLOCK)) and whole[r.n_bytes :] == b"\xff" * (len(whole) - r.n_bytes)
    assert flac.pcm_blocks(flac.media(none)).count() == 0


def test_media_digests(spark, small, docs):
    texts = dict(docs)
    for r in flac.op6_media(spark, small).collect():
        p = flac.padded(texts[r.doc_id].encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id].encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))


# ---- 7


def _brute_spans(text):
    out = [("email", *m.span()) for m in re.finditer(pii.EMAIL, text)]
    out += [("ip", *m.span()) for m in re.finditer(pii.IP, text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(pii.CARD, text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(pii.PHONE, text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_base_entities_equal_plain_patterns():
    rng = random.Random(3)
    parts = [*"ab1.@-_+% é(", "@b.c", "a@", "12", "..", "+1 (212) 555-1234", "4111 1111 1111 1111", "1.2.3.4", "300.1.1.1", " "]
    for _ in range(20000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(t) == _brute_spans(t), t


def test_unseen_identifiers_are_found_by_context(spark):
    rows = [(i, f"please send money to {['a%d@mail.com' % i, 'K9-77%d' % i][i % 10 == 0]} today") for i in range(100)] + [(200, "order number 55512 shipped")]
    got = {r.doc_id: [s.asDict() for s in r.added] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string"), confidence=0.8).collect()}
    assert got[10] == [{"kind": "email", "start": 21, "end": 28}] and got[200] == [] and got[11] == []


def test_discovered_identifiers_discover_others(spark):
    rows = [f"please send money to a{i}@mail.com today" for i in range(20)] + [f"please send money to K9-77{i} today" for i in range(4)]
    rows += [f"our good customer number K9-77{i} called" for i in range(4)] + ["our good customer number Z1-555 called", "a pipe of size 12345 there"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = lambda rounds: {r.doc_id for r in pii.personal_data(df, rounds=rounds).collect() if len(r.added)}
    assert found(1) == {20, 21, 22, 23} and found(20) == set(range(20, 29))


def test_pattern_graph_equals_brute_force(spark):
    rng = random.Random(11)
    kinds = {f"i{k}": rng.choice(pii.KINDS) if rng.random() < 0.62 else None for k in range(60)}
    edges = sorted({(f"p{rng.randint(0, 14)}", f"i{rng.randint(0, 59)}") for _ in range(160)})
    of = {}
    for p, i in edges:
        of.setdefault(p, []).append(i)
    score, as_kind, want, steady = {i: float(k is not None) for i, k in kinds.items()}, dict(kinds), {}, {}
    while True:
        now = {}
        for p, held in of.items():
            good = [as_kind[i] for i in held if score[i] >= 0.6]
            sure = sum(score[i] for i in held) / (len(held) + 0.5)
            if len(held) > 3 and len(good) >= 3 and sure >= 0.6:
                now[p] = (max((good.count(k), k) for k in pii.KINDS)[1], sure)
        sure = {p: sum(score[i] for i in held) / (len(held) + 0.5) for p, held in of.items()}
        done = set(now) == set(want) and steady == sure
        want, steady = now, sure
        if done:
            break
        for i, k in kinds.items():
            mine = [now[p] for p in now if i in of[p]]
            if k is None and mine:
                score[i] = 1 - np.prod([1 - min(c, 0.999) for _, c in mine])
                as_kind[i] = max((c, k) for k, c in mine)[1]
    df = spark.createDataFrame([(p, i, kinds[i]) for p, i in edges], "pattern string, instance string, kind string")
    got = {r.pattern: (r.kind, r.confidence) for r in pii.patterns(df).collect()}
    assert len(want) > 3 and {p: k for p, (k, _) in got.items()} == {p: k for p, (k, _) in want.items()}
    assert all(got[p][1] == pytest.approx(c) for p, (_, c) in want.items())


def test_patterns_grow_to_their_fixed_point(spark):
    """p2 has no seed and passes only when p1's confidence, which has stopped adding patterns by then, has grown far enough."""
    edges = [("p1", f"s{k}", "email") for k in range(6)] + [(p, f"u{k}", None) for p in ("p1", "p2") for k in range(3)] + [("p2", "u3", None), ("p3", "u3", None)]
    got = {r.pattern: r.confidence for r in pii.patterns(spark.createDataFrame(edges, "pattern string, instance string, kind string")).collect()}
    p1 = p2 = 0.0
    for _ in range(1000):  # the equations of the fixed point, from below
        u = 1 - (1 - p1) * (1 - (p2 if p2 >= 0.6 else 0))
        u3 = p2 if p2 >= 0.6 else 0
        p1, p2 = (6 + 3 * u) / 9.5, (3 * u + u3) / 4.5
    assert set(got) == {"p1", "p2"} and got["p1"] == pytest.approx(p1, abs=1e-4) and got["p2"] == pytest.approx(p2, abs=1e-4)


@pytest.mark.parametrize("text", ["7" * (1 << 20), "a" * (1 << 20) + "7", "1." * (1 << 19), "a.b_" * (1 << 18), "a@b.c " * (1 << 17), "+1(" * (1 << 18)])
def test_long_texts_are_scanned_in_linear_time(text):
    began = time.time()
    base = pii.base_spans(text)
    spans = pii.candidates(text, base)
    context = pii._Context(text)
    for a, b in [(a, b) for _, a, b in base] + spans:
        context.patterns(a, b)
    assert time.time() - began < 5


def test_personal_data_of_odd_rows(spark, odd, none, small, docs):
    assert pii.personal_data(odd).count() == len(ODD) and pii.personal_data(none).count() == 0
    texts = dict(docs)
    for r in pii.op7_pii(spark, small).collect():
        spans = _brute_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert r.n_email == sum(k == "email" for k, *_ in spans)


# ---- 8


def test_tokens_equal_whole_encodings(spark, small, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    got = {r.doc_id: r for r in tokens.op8_tokens(spark, small).collect()}
    start = 0
    for d, t in sorted(docs):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_pieces_of_odd_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    rng = random.Random(1)
    parts = ["a", "B", "é", "ñ", " ", "  ", "\n", "\t", "'s", "'", "1", "²", "日本", " ", " ", "　", ".", "!!", "\r\n", "\x85", "\x1c", "'re", "_", "€", "«", "×", "<|endoftext|>", "😀"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    data, at = common.raw(common.utf8(pa.array(texts)))
    ids, counts = tokens.Encoder(public_tokenizers.path(tokens.TOKENIZER)).documents(data, at)
    upto = np.append(0, np.cumsum(counts))
    for k, t in enumerate(texts):
        assert ids[upto[k] : upto[k + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_added_tokens_are_encoded_as_the_file_has_them(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    rng = random.Random(9)
    parts = ["a", "B", "é", " ", "  ", "\n", "'s", "1", "日本", ".", "<|endoftext|>", "<|endoftext|>", "<|endof", "text|>", "<", "|>"]
    texts = ["one<|endoftext|>two", "x<|endof", "text|>y", "", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000))]
    data, at = common.raw(common.utf8(pa.array(texts)))
    ids, counts = tokens.encoder(public_tokenizers.path(tokens.TOKENIZER)).documents(data, at)
    upto = np.append(0, np.cumsum(counts))
    for k, t in enumerate(texts):
        assert ids[upto[k] : upto[k + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids, t
    got = {r.doc_id: r for r in tokens.token_files(spark.createDataFrame(list(enumerate(texts[:4])), "doc_id long, text string")).collect()}
    assert (got[0].n_tokens, got[0].ids_crc32, got[1].start) == (4, zlib.crc32(np.array([505, 50256, 11545, 0], "<u4").tobytes()), 4)


def test_pieces_of_one_hash_keep_their_own_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(tokens.TOKENIZER)
    tok = Tokenizer.from_file(path)
    turns = [0]
    while len(turns) < 2048:  # the Thue-Morse words of this length have one polynomial hash modulo 2^64
        turns += [1 - t for t in turns]
    one, two = ("".join(ab[t] for t in turns) for ab in ("ab", "ba"))
    data, at = common.raw(common.utf8(pa.array([one, two])))
    assert len(set(common.span_hashes(data, at[:-1], at[1:]).tolist())) == 1
    for texts in ([one, two, one], [two, one], [f"{one} {two}", "a", two, ""]):
        encoder = tokens.Encoder(path)
        for _ in range(2):  # then from the cache
            ids, counts = encoder.documents(*common.raw(common.utf8(pa.array(texts))))
            upto = np.append(0, np.cumsum(counts))
            assert [ids[a:b].tolist() for a, b in zip(upto, upto[1:])] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("widths", [(8, 8, 8, 8), (12, 4, 16), (16, 16)])
def test_any_token_is_read_alone(widths):
    rng = np.random.default_rng(0)
    ids = np.where(rng.random(5000) < 0.5, rng.integers(0, 256, 5000), rng.integers(0, 2**32, 5000, dtype=np.uint64)).astype(np.uint32)
    shard = tokens.Shard(tokens.encode_shard(ids, np.array([4, 9]), np.array([1000, 5000]), widths))
    assert (shard.all() == ids).all() and shard.ends.tolist() == [1000, 5000]
    assert all(shard.token(i) == int(ids[i]) for i in range(0, 5000, 7))


def test_tokens_of_odd_rows(odd, none):
    got = tokens.token_files(odd).collect()
    assert len(got) == len(ODD) and sum(r.n_tokens for r in got) == max(r.start + r.n_tokens for r in got)
    assert next(r for r in got if r.doc_id is None).start == 0 and next(r for r in got if r.doc_id == 1).n_tokens == 1
    assert tokens.token_files(none).count() == 0


# ---- 9


def _words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_contamination_equals_brute_force(spark, small, docs):
    windows = {}
    for r in common.table(spark, small, "benchmark").collect():
        w = _words(r.text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(r.item_id))
    lengths = {len(k) for k in windows}
    got = {r.doc_id: r for r in decontamination.op9_decontamination(spark, small).collect()}
    for d, t in docs:
        w, hit, items = _words(t), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i : i + n]))
                if found:
                    hit.update(range(i, i + n))
                    items |= found
        r = got[d]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(items), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def test_contamination_spans_parts_and_odd_rows(spark, odd, none):
    item = "One two, three FOUR five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, item), (2, "short Item"), (3, None), (None, item), (4, "!!"), (2, "short Item")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x: " + item.upper() + "!", "k"), (2, "a SHORT item", "k"), (2, "clean", "k"), (3, None, "k")], "doc_id long, text string, items string")
    one = decontamination.contamination(docs, bench)
    many = decontamination.contamination(docs, bench, automaton_bytes=20)
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
    got = {(r.doc_id, r.n_words): r for r in one.collect()}
    assert (got[1, 12].n_hit, got[1, 12].items, got[1, 12].spans[0].start, got[1, 12].spans[0].end) == (11, ["1"], 3, 3 + len(item))
    assert got[2, 3].items == ["2"] and got[2, 1].n_hit == 0 and got[3, 0].n_hit == 0
    assert decontamination.contamination(odd, bench).count() == len(ODD) and decontamination.contamination(none, bench).count() == 0
    assert decontamination.contamination(odd, bench.limit(0)).where("n_hit > 0").count() == 0


def test_stages_decide_by_row(spark):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randint(0, 9999)}" for _ in range(40)) for _ in range(6)]
    bench = spark.createDataFrame([(1, texts[0]), (None, texts[3])], "item_id long, text string")
    path = common.fresh_path(spark, "bench")
    bench.write.parquet(f"{path}/benchmark.parquet")
    rows = [(7, texts[0]), (7, texts[1]), (None, texts[3]), (None, texts[4]), (None, texts[4]), (9, texts[5]), (None, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    once = {(r.doc_id, r.text) for r in simhash.one_of_each_group(spark, docs, "").collect()}
    assert once == set(rows) - {(None, texts[5])} and simhash.one_of_each_group(spark, docs, "").count() == len(once)
    clean = decontamination.decontaminated(spark, docs, path).collect()
    assert sorted(map(str, clean)) == sorted(map(str, docs.where(~F.col("text").isin(texts[0], texts[3])).collect()))
    listed = {tuple(r["items"]) for r in decontamination.contamination(docs.where(F.col("text") == texts[3]), bench).collect()}
    assert listed == {()}


# ---- 10


def test_mix_comes_near_its_targets(spark):
    d = "/root/testdata/sf0.01"
    got = mixing.op10_mixing(spark, d).join(common.table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    for r in got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max(F.col("taken") / F.greatest("size", F.lit(1))).alias("most")).collect():
        assert abs(r.taken - r.target) <= max(50, 0.01 * r.target) and r.most <= 3


def _greedy(rows, target, gap, f, mean_lean, seed="mix"):
    """The ids of one source's rows (id, text, size) that the order gives one more copy."""
    order = {}
    for i, text, size in rows:
        u = (int(hashlib.md5(f"{i}:{hashlib.md5(text.encode()).hexdigest()}:{seed}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        p = f * (1 + 0.5 * (1 - f) * (mean_lean - size * 1000000 // (size + 256)) / 1000000)
        if size:
            order[i] = (u / (1 - u)) / (p / (1 - p)), size
    taken, most = set(), gap
    for i in sorted(order, key=order.get):
        size = order[i][1]
        if size <= gap:
            taken.add(i)
            gap -= size
        elif size <= most:
            if gap <= 0.001 * target:
                break
            most = gap
    near = [i for i in sorted(order, key=order.get) if i not in taken and order[i][1] <= gap + 0.01 * target] if gap > 0.001 * target else []
    taken.update(near[:1])
    return taken, gap - sum(order[i][1] for i in near[:1])


@pytest.mark.parametrize("per_bin", [1000, 3])
def test_mix_passes_over_what_does_not_fit(spark, per_bin):
    rng = random.Random(7)
    rows = [(i, " ".join(["w"] * (20000 if i % 150 == 3 else rng.randint(1, 400))), "ab"[i % 3 == 0]) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mixture(df, bin_documents=per_bin).collect()}
    for source in "ab":
        mine = [(i, t, len(t.split())) for i, t, s in rows if s == source]
        words = sum(size for _, _, size in mine)
        target = got[mine[0][0]].target
        whole = int(target // words)
        lean = sum(size * 1000000 // (size + 256) * size for _, _, size in mine) / words
        taken, gap = _greedy(mine, target, target - whole * words, target / words - whole, lean)
        assert {i for i, _, _ in mine if got[i].copies == whole + 1} == taken and abs(gap) <= 0.01 * target


def test_inclusion_follows_the_odds_over_seeds(spark):
    rows = [(i, " ".join(["w"] * (40 if i % 2 else 400)), "ab"[i % 5 == 0]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    times, seeds = {}, 6
    for seed in range(seeds):
        for r in mixing.mixture(df, seed=f"s{seed}").where("copies > 0").collect():
            times.setdefault((r.source, r.size), []).append(r.copies)
    first = mixing.mixture(df).groupBy("source").agg(F.first("source_size").alias("s"), F.first("target").alias("t")).collect()
    for r in first:
        e = r.t / r.s
        n = {size: sum(1 for i, t, s in rows if s == r.source and len(t.split()) == size) for size in (40, 400)}
        lean = sum(n[z] * z * (z * 1000000 // (z + 256)) for z in n) / r.s
        f, whole = e % 1, int(e)
        for z in n:
            p = whole + f * (1 + 0.5 * (1 - f) * (lean - z * 1000000 // (z + 256)) / 1000000)
            drawn = sum(times.get((r.source, z), [])) / (seeds * n[z])
            assert abs(drawn - p) < 4 * (0.25 / (seeds * n[z])) ** 0.5, (r.source, z, drawn, p)


def test_water_filling_and_odd_rows(spark, odd, none):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 0), (None, 100)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert got["a"] == 30 and got["c"] == 0 and got[None] == 300 and abs(sum(got.values()) - 1110) < 1e-6 and got["b"] == pytest.approx(780)
    df = odd.drop("size").withColumnRenamed("row", "source_size").withColumns({c: F.lit(1) for c in ("mix", "u", "rank", "gap", "steps", "of", "bin")})
    out = mixing.mixture(df)
    assert out.columns == [*[c for c in df.columns if c != "source_size"], "size", "source_size", "target", "copies"]
    assert out.count() == len(ODD) and mixing.mixture(none.drop("size")).count() == 0
    assert sorted(map(str, out.collect())) == sorted(map(str, mixing.mixture(df.repartition(3)).collect()))


# ---- pipeline


def test_pipeline_stages(spark, small, docs):
    import corpus_pipeline

    held = common.table(spark, small, "documents")
    columns = held.columns
    for name, stage in corpus_pipeline.STAGES:
        before = held
        held = common.stored(stage(spark, before, small), f"test-{name}")
        if name != "tokens":
            assert held.columns == columns
        if name in ("toxicity", "near_duplicates", "decontamination"):
            assert held.exceptAll(before).count() == 0 and 0 < held.count() <= before.count()
        if name == "near_duplicates":
            rows = sorted((r.doc_id, r.text) for r in before.collect())
            sets = [_shingled(t) for _, t in rows]
            f = simhash.Forest(len(rows))
            alike = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
            f.add(*np.array(alike).T)
            assert sorted(r.doc_id for r in held.collect()) == sorted(rows[k][0] for k in set(f.root.tolist()))
        if name == "decontamination":
            assert decontamination.contamination(held, common.table(spark, small, "benchmark")).where("n_hit > 0").count() == 0
        if name == "tokens":
            assert held.count() == before.count()


def test_stages_take_odd_and_empty_tables(spark, odd, none, small):
    import corpus_pipeline

    for docs in (odd, none):
        docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, small).count() >= 0


def test_texts_without_quotes_stay_as_they_are(spark):
    rows = [(1, 0, "u", "  indented code\n"), (1, 1, "u", "> indented code\n\n  answer "), (1, 2, "u", " a > b "), (1, 3, "u", None), (1, 4, "u", " \t> all quoted")]
    got = quotes.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("turn").collect()
    assert [r.text for r in got] == ["  indented code\n", "\n  answer", " a > b ", None, ""]


def test_word_scores_equal_plain_counting(spark):
    """Learning and the scores of words, by dictionaries over real keys."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abéцß") for _ in range(rng.randint(1, 5)))
    vocabulary = {lang: [word() for _ in range(25)] for lang in ("x", "y", "z")}
    rows = [(i, " ".join(rng.choice(vocabulary[lang]) for _ in range(20)), lang) for i, lang in enumerate(rng.choices("xyz", k=60))]
    model = language.learn(spark.createDataFrame([*rows, (None, "a", "x"), (99, None, "y"), (98, "b", None)], "doc_id long, text string, lang string"))
    languages = sorted({r[2] for r in rows})
    words = {lang: Counter() for lang in languages}
    grams = {lang: Counter() for lang in languages}
    around = lambda w: [(b"\0" + w + b"\0")[i : i + 3] for i in range(len(w))]
    for _, text, lang in rows:
        for w in text.encode().split():
            words[lang][w] += 1
            grams[lang].update(around(w))
    v, g = len(set().union(*words.values())) + 1, len(set().union(*grams.values())) + 1
    tested = [word().encode() for _ in range(30)] + [rng.choice(vocabulary["x"]).encode() for _ in range(30)]
    got = model.whole(language.Words(pa.RecordBatch.from_arrays([pa.array([b" ".join(tested).decode()])], names=["text"])).keys())
    scores = model.word_scores(language.Words(pa.RecordBatch.from_arrays([pa.array([b" ".join(tested).decode()])], names=["text"])))
    ruled = ~model.allowed
    for i, w in enumerate(tested):
        for k, lang in enumerate(languages):
            whole = np.log((words[lang][w] + 1) / (sum(words[lang].values()) + v))
            mean = sum(np.log((grams[lang][t] + 1) / (sum(grams[lang].values()) + g)) for t in around(w)) / len(w)
            assert got[i, k] == pytest.approx(whole, abs=1e-4)
            if not ruled.any():
                assert scores[i, k] == pytest.approx(whole + 2 * mean, abs=1e-3)


def test_languages_of_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, words int")
    assert language.learn(empty) is None and language.labelled(empty, None).count() == 0
    assert language.labelled(empty, language.learn(spark.createDataFrame([(1, "ab", "x")], "doc_id long, text string, lang string"))).count() == 0
