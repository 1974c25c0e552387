"""Language identification: script ranges narrow a word's candidates, Viterbi over per-word scores labels spans.

A word's score for a language is the mean log-probability of its byte trigrams (with word ends) and of the word itself in that
language, learned from labelled texts with add-one smoothing over the trigrams and word hashes that the sample has (no two share a row). A word's script (by ranges of
code points) leaves only the languages in whose labelled texts at least SCRIPT_SHARE of the letters have that script; a word in a script of no language
is scored alike for all. Over the words of a text, the best path of languages pays SWITCH for every change; its runs are the
spans, and the language with the most letters on the path is the text's.

Learning: of each language about ``rows`` texts (those whose hash of the id is small enough), a bound that keeps the tables' counts small;
the tables grow with the vocabulary of these texts, not with the corpus. Counting is Spark aggregation.

Ties: of paths equally good a word takes the language that stays, else the first by name; of languages with equally many letters the first by name is the text's. A
very long text is one vectorised step of a task and goes on word by word, in linear time. Empty tables give no rows, or, as training texts, no model. Other columns aren't read.

Nulls: a null text, or one without a letter, is `und` with score 0. Null languages are not learned from. A null doc_id is
labelled but never learned from. Without any labelled text every text is `und`. Repeated rows are labelled alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ROWS = 3000
SWITCH = 3.0
SCRIPT_SHARE = 0.01
UNKNOWN = "und"
#: Texts still going on at or below which the path goes on text by text instead of a word of all of them at a time.
FEW = 8

#: First code points of script ranges, and the scripts' names.
_RANGES = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Indic"), (0x0E00, "Thai"), (0x0E80, "Asian"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Other"),
    (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"), (0x20000, "Han"),
]
SCRIPTS = sorted({name for _, name in _RANGES})
_FROM = np.array([first for first, _ in _RANGES])
_SCRIPT = np.array([SCRIPTS.index(name) for _, name in _RANGES])
_LOW = common.word_table()
_LOW[0x30:0x3A] = 0  # digits are no letters


class Words:
    """The words of a slice: where they are, whose they are, their script and their features."""

    def __init__(self, batch: pa.RecordBatch):
        data, self.at = common.raw(common.utf8(common.col(batch, "text")))
        self.low = low = _LOW[data]
        self.starts, self.ends = common.word_spans(low > 0, self.at)
        self.owner = np.searchsorted(self.at, self.starts, "right") - 1
        self.size = self.ends - self.starts
        # the script of a word is that of its first character beyond ASCII, or Latin
        self.script = np.full(len(self.starts), SCRIPTS.index("Latin"))
        first = low[np.minimum(self.starts, max(0, len(low) - 1))] if len(low) else low
        high = np.flatnonzero(first >= 0xC2)
        if len(high):
            s = self.starts[high]
            byte = [low[np.minimum(s + k, len(low) - 1)].astype(np.int64) for k in range(4)]
            point = np.select([byte[0] < 0xE0, byte[0] < 0xF0], [(byte[0] & 31) << 6 | byte[1] & 63, (byte[0] & 15) << 12 | (byte[1] & 63) << 6 | byte[2] & 63], (byte[0] & 7) << 18 | (byte[1] & 63) << 12 | (byte[2] & 63) << 6 | byte[3] & 63)
            self.script[high] = _SCRIPT[np.searchsorted(_FROM, point, "right") - 1]

    def trigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """The trigram around each byte of a word, as a number below 2^24, and the word of each; a text's bounds are as blanks."""
        index = np.flatnonzero(self.low)
        padded = np.zeros(len(self.low) + 2, np.int64)
        padded[1:-1] = self.low
        bound = np.zeros(len(self.low) + 1, bool)
        bound[self.at] = True
        before, after = np.where(bound[index], 0, padded[index]), np.where(bound[index + 1], 0, padded[index + 2])
        return before << 16 | padded[index + 1] << 8 | after, np.repeat(np.arange(len(self.starts)), self.size)

    def keys(self) -> np.ndarray:
        """The hash of each word."""
        return common.span_hashes(self.low, self.starts, self.ends).view(np.int64)


class Model:
    """Counts by real keys, of trigrams and words: those that the sample has, in ascending order.

    The words' table is sparse: of a key only the languages that have it. A key that no language has counts 0 in all.
    """

    def __init__(self, languages: list[str], trigrams: tuple, words: tuple, scripts: np.ndarray):
        """trigrams and words: keys, languages (by place) and counts, a row each; scripts: counts by (script, language)."""
        self.languages = languages
        key, k, n = trigrams
        self.trigram_keys = np.unique(key)
        counts = np.zeros((len(self.trigram_keys) + 1, len(languages)))  # the last row: any other
        counts[np.searchsorted(self.trigram_keys, key), k] = n
        self.trigrams = np.log((counts + 1) / (counts.sum(0) + len(counts))).astype(np.float32)
        key, k, n = words
        order = np.argsort(key, kind="stable")
        self.word_keys, first = np.unique(key[order], return_index=True)
        self.word_at = np.append(first, len(order))
        self.word_language, self.word_more = k[order], np.log1p(n[order]).astype(np.float32)
        sizes = np.bincount(k, n, len(languages))
        self.word_base = -np.log(sizes + len(self.word_keys) + 1).astype(np.float32)
        share = scripts / np.maximum(scripts.sum(0), 1)
        self.allowed = share >= SCRIPT_SHARE
        self._row: np.ndarray | None = None

    def rows(self, trigrams: np.ndarray) -> np.ndarray:
        """The row of each trigram; the table that tells is made where it is used."""
        if self._row is None:
            self._row = np.full(1 << 24, len(self.trigram_keys), np.int32)
            self._row[self.trigram_keys] = np.arange(len(self.trigram_keys))
        return self._row[trigrams]

    def whole(self, keys: np.ndarray) -> np.ndarray:
        """(words, languages): the log-probability of each word as a whole."""
        out = np.repeat(self.word_base[None], len(keys), 0)
        if not len(self.word_keys):
            return out
        at = np.minimum(np.searchsorted(self.word_keys, keys), len(self.word_keys) - 1)
        known = np.flatnonzero(self.word_keys[at] == keys)
        at = at[known]
        many = self.word_at[at + 1] - self.word_at[at]
        word = np.repeat(known, many)
        entry = np.repeat(self.word_at[at] - np.append(0, np.cumsum(many))[:-1], many) + np.arange(len(word))
        out[word, self.word_language[entry]] += self.word_more[entry]
        return out

    def word_scores(self, words: Words) -> np.ndarray:
        """(words, languages): the mean log-probability of the features; what the script rules out is far below."""
        row = self.rows(words.trigrams()[0])
        n = len(words.starts)
        out = self.whole(words.keys())
        first = np.append(0, np.cumsum(words.size))[:-1]
        for k in range(len(self.languages) if n else 0):
            # a word as a whole weighs as much as its trigrams together
            out[:, k] += 2 * np.add.reduceat(self.trigrams[row, k], first) / words.size
        some = self.allowed.any(1)[words.script]
        out[~some] = 0
        out[some] -= np.where(self.allowed[words.script[some]], 0, 50).astype(np.float32)
        return out

    def path(self, words: Words, switch: float = SWITCH) -> np.ndarray:
        """The language of each word on its text's best path."""
        return best_paths(self.word_scores(words), words.owner, switch)


def best_paths(scores: np.ndarray, owner: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best path over the words of each text; scores: (words, languages), owner: the text of each word, ascending.

    All texts take a step at a time, the longest ones last. Once FEW are left, each goes on by itself over plain floats, so that time
    grows with the words and not with the longest text; the sums are the same ones in the same order, so a text's path doesn't
    depend on those beside it.
    """
    n = len(scores)
    if not n:
        return np.zeros(0, np.int64)
    scores = scores.astype(np.float64)
    _, first, length = np.unique(owner, return_index=True, return_counts=True)
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    active = np.searchsorted(-length, -np.arange(length[0]) - 1, "right")  # texts that have a word t
    together = int(np.searchsorted(-active, -FEW, "left"))  # steps of more than FEW texts
    before = np.empty_like(scores)  # of each word: the sums of the best paths up to the one before
    total = scores[first].copy()
    for t in range(1, together):
        live = total[: active[t]]
        at = first[: active[t]] + t
        before[at] = live
        total[: active[t]] = np.maximum(live, live.max(1)[:, None] - switch) + scores[at]
    if together < length[0]:
        for text in range(active[max(together, 1)] if max(together, 1) < length[0] else 0):
            live, begin = total[text].tolist(), max(together, 1)
            for k in range(begin, int(length[text]), 1 << 14):
                a, b = first[text] + k, first[text] + min(k + (1 << 14), int(length[text]))
                held = []
                for row in scores[a:b].tolist():
                    held.append(live)
                    jump = max(live) - switch
                    live = [(x if x >= jump else jump) + s for x, s in zip(live, row, strict=True)]
                before[a:b] = held
            total[text] = live
    # back: where a path came from, if it didn't stay
    top = before.argmax(1)
    stay = before >= before[np.arange(n), top][:, None] - switch
    out = np.empty(n, np.int64)
    here = total.argmax(1)
    split = max(together, 1)
    for text in range(active[split] if split < length[0] else 0):
        state = int(here[text])
        for k in range(int(length[text]), split, -(1 << 14)):
            a, b = first[text] + max(k - (1 << 14), split), first[text] + k
            back = []
            for s, m in zip(stay[a:b][::-1].tolist(), top[a:b][::-1].tolist(), strict=True):
                back.append(state)
                if not s[state]:
                    state = m
            out[a:b] = back[::-1]
        here[text] = state
    for t in range(min(split, int(length[0])) - 1, -1, -1):
        a = active[t]
        at = first[:a] + t
        out[at] = here[:a]
        if t:
            here[:a] = np.where(stay[at, here[:a]], here[:a], top[at])
    return out


def learn(documents: DataFrame, rows: int = ROWS) -> Model | None:
    """The model of documents (doc_id, text, lang); about rows texts of each language, chosen by a hash of doc_id."""
    common.small_batches(documents.sparkSession)
    given = documents.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "text", "lang")
    # a row per language, small however large the corpus
    sizes = {r.lang: r.n for r in given.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    number = {lang: k for k, lang in enumerate(languages)}
    share = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, rows / sizes[lang])))])
    place = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(number[lang]))])
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language")), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)
    sample = given.where(drawn).select("text", place[F.col("lang")].cast("int").alias("k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            words = Words(batch)
            of = common.col(batch, "k").to_numpy()[words.owner] if len(words.owner) else np.zeros(0, np.int64)
            trigram, word = words.trigrams()
            for k in np.unique(of).tolist():
                mine = of == k
                for kind, got in ((0, trigram[mine[word]]), (1, words.keys()[mine]), (2, words.script[mine])):
                    key, n = np.unique(got, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(np.full(len(key), k, np.int32)), pa.array(key.astype(np.int64)), pa.array(n)], names=["kind", "k", "key", "n"])

    # as large as the sample's vocabulary: about rows texts a language
    got = sample.mapInArrow(run, "kind int, k int, key long, n long").groupBy("kind", "k", "key").agg(F.sum("n").alias("n")).toArrow()
    kind, k, key, n = (got.column(c).to_numpy() for c in ("kind", "k", "key", "n"))
    trigrams, words, scripts = ((key[kind == t], k[kind == t], n[kind == t]) for t in range(3))
    table = np.zeros((len(SCRIPTS), len(languages)))
    table[scripts[0], scripts[1]] = scripts[2]
    return Model(languages, trigrams, words, table)


def labelled(documents: DataFrame, model: Model | None, spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score (the share of letters on the path that are in lang_pred) and, on demand, spans.

    spans: array of (start, end, lang) in bytes of UTF-8, each from the first word of a run to its last.
    """
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", has_letter.alias("letters"))
    if model is None:
        return source.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.expr("cast(array() as array<struct<start:int,end:int,lang:string>>)").alias("spans"))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, UNKNOWN], object)
        for batch in common.slices(batches, limit=8 * common.SLICE_BYTES):  # more texts at once: fewer steps of the path
            words = Words(batch)
            path = m.path(words)
            texts, languages = batch.num_rows, len(m.languages)
            letters = np.bincount(words.owner * languages + path, words.size, texts * languages).reshape(texts, languages)
            total = letters.sum(1)
            real = common.col(batch, "letters").to_numpy(zero_copy_only=False) & (total > 0)
            best = np.where(real, letters.argmax(1), languages)
            score = np.where(real, letters.max(1) / np.maximum(total, 1), 0.0)
            found: list[list[dict]] = [[] for _ in range(texts)]
            if spans and len(path):
                new = np.flatnonzero(np.append(True, (path[1:] != path[:-1]) | (words.owner[1:] != words.owner[:-1])))
                for a, b in zip(new.tolist(), [*new[1:].tolist(), len(path)], strict=True):
                    doc = int(words.owner[a])
                    found[doc].append({"start": int(words.starts[a] - words.at[doc]), "end": int(words.ends[b - 1] - words.at[doc]), "lang": m.languages[path[a]]})
            yield pa.RecordBatch.from_arrays([common.col(batch, "doc_id"), pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(found, kind)], names=["doc_id", "lang_pred", "score", "spans"])

    common.small_batches(documents.sparkSession)
    return source.mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = learn(docs.where(common.crc_mod("doc_id", 4) != 2).select("doc_id", "text", "lang"))
    return labelled(docs, model).select("doc_id", F.coalesce(common.crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
