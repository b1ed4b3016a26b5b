"""Text statistics per document, and the shares of prose, list, table and junk by a hidden Markov model.

A document is a sequence of lines. The hidden state of a line is its kind; what is seen are the
discrete features of :mod:`pairloom.llm.lines`. Training starts from lines of a bounded sample that a
few strict rules can name; emissions and transitions are then trained by Viterbi training. Decoding
knows no rules: the most likely states of all lines of every document give the shares. Captions and
page headers go with the prose around them as the model's transitions have it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm import lines as L

KINDS = ("prose", "list", "table", "junk")
PROSE, LIST, TABLE, JUNK = range(4)
#: Hidden states; several make up a kind, as kinds come in several looks.
PLAIN, TERSE, ITEMS, FIELDS, ENTRIES, CELLS, NUMBERS, SALAD, NOISE, PAGE = range(10)
KIND_OF = np.array([PROSE, PROSE, LIST, LIST, LIST, TABLE, TABLE, JUNK, JUNK, JUNK], np.int8)
STATES = len(KIND_OF)
FLUENCY = L.FEATURES.index("fluency")
#: Bytes of text that are measured at once.
SLICE = 3_000_000
#: Features of a line depend on each other; their joint weight is lowered by this factor.
TEMPER = 0.3
#: How words follow each other does not depend on the other features: where it is known, its weight is so many times theirs.
FLUENCY_SAY = 3.0


@dataclass(frozen=True)
class LineModel:
    """The word lists, the log probabilities of word-class pairs, of features by kind, and of kinds after kinds."""

    known: L.Words
    fluency: np.ndarray
    emission: tuple[np.ndarray, ...]
    transition: np.ndarray
    start: np.ndarray

    def scores(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), STATES))
        for i, table in enumerate(self.emission):
            out += table[codes[:, i]]
        fluency = codes[:, FLUENCY]
        out += np.where(fluency > 0, FLUENCY_SAY - 1.0, 0.0)[:, None] * self.emission[FLUENCY][fluency]
        return out * TEMPER


def viterbi(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, transition: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The most likely states of many sequences at once. ``scores`` has the rows of all of them one after another."""
    kinds = scores.shape[1]
    states = np.zeros(len(scores), np.int8)
    if not len(scores):
        return states
    order = np.argsort(-lengths, kind="stable")
    begin, size = starts[order], lengths[order]
    back = np.zeros((len(scores), kinds), np.int8)
    best = start + scores[begin[size > 0]]
    order_live = np.searchsorted(-size, -np.arange(int(size[0])), side="left")  # sequences longer than t
    final = best.copy()
    for t in range(1, int(size[0])):
        live = order_live[t]
        step = best[:live, :, None] + transition
        back[begin[:live] + t] = step.argmax(1)
        best = step.max(1) + scores[begin[:live] + t]
        final[:live] = best
    held = int((size > 0).sum())
    state = final.argmax(1).astype(np.int8)
    states[begin[:held] + size[:held] - 1] = state
    for t in range(int(size[0]) - 1, 0, -1):
        live = order_live[t]
        at = begin[:live] + t
        states[at - 1] = back[at, states[at]]
    return states


def seeds(codes: np.ndarray) -> np.ndarray:
    """The state of lines of which it is plain, else -1."""
    f = {name: codes[:, i] for i, name in enumerate(L.FEATURES)}
    out = np.full(len(codes), -1, np.int8)
    stops = f["end"] == 0
    marked = f["begin"] <= 1
    fluent = (f["fluency"] == 0) | (f["fluency"] >= 4)
    clean = (f["symbols"] <= 3) & (f["foreign"] <= 2) & (f["digits"] <= 3) & (f["columns"] == 0) & (f["stutter"] <= 2) & (f["blanks"] >= 2)
    plain = clean & fluent & (f["commas"] <= 3) & (f["titled"] <= 3) & (f["copies"] <= 1) & (f["stops"] <= 2) & ~marked & (f["repeats"] <= 2)
    out[plain & (f["words"] >= 4) & (f["stops"] >= 1) & (f["titled"] <= 2) & (f["begin"] >= 3)] = TERSE
    out[plain & (f["words"] >= 5) & (f["common"] >= 2) & (stops | (f["words"] >= 6))] = PLAIN
    out[plain & (f["words"] >= 4) & (f["fluency"] >= 4) & (f["common"] >= 2)] = PLAIN
    short = f["words"] <= 5
    listed = (f["repeats"] >= 2) & short & (f["columns"] <= 1) & (f["foreign"] <= 2)
    out[listed & (marked | (f["begin"] == 2))] = ITEMS
    out[listed & (f["words"] <= 3) & (f["commas"] >= 4) & ~marked] = FIELDS
    out[(f["repeats"] >= 2) & (f["titled"] >= 3) & (f["words"] >= 3) & (f["columns"] == 0) & (f["commas"] >= 2) & ~marked] = ENTRIES
    out[(f["commas"] == 5) & (f["words"] >= 3) & ~stops & (f["columns"] == 0)] = ENTRIES
    out[(f["end"] == 2) & (f["commas"] >= 3) & (f["words"] >= 5) & (f["repeats"] >= 2)] = ENTRIES
    out[(f["stops"] == 4) & (f["words"] >= 1)] = ENTRIES  # dotted lines of contents
    cells = (f["columns"] >= 2) & (f["repeats"] >= 1)
    out[cells & (f["words"] <= 6)] = CELLS
    out[(f["digits"] >= 5) & (f["words"] <= 4) & (f["length"] >= 2) & ~cells] = NUMBERS
    out[(f["fluency"] >= 1) & (f["fluency"] <= 2) | (f["stutter"] == 4) & (f["words"] >= 4)] = SALAD
    noise = (f["symbols"] >= 6) & (f["columns"] == 0) | (f["foreign"] >= 4) | (f["blanks"] == 0) & (f["length"] >= 3)
    out[noise & (f["length"] >= 2) & (f["words"] >= 1)] = NOISE
    out[(f["begin"] == 5) & (f["symbols"] >= 5)] = PAGE
    out[(f["copies"] >= 2) & (f["words"] >= 2) & (f["words"] <= 5) & ~stops & (f["digits"] <= 2) & (f["columns"] <= 1)] = PAGE
    return out


def _emissions(codes: np.ndarray, state: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    out = []
    for i, size in enumerate(L.SIZES):
        counts = np.full((size, STATES), 0.5)
        held = state >= 0
        np.add.at(counts, (codes[held, i], state[held]), weight[held])
        out.append(np.log(counts / counts.sum(0)))
    return tuple(out)


def train(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, known: L.Words, fluency: np.ndarray, rounds: int = 3) -> LineModel:
    """Viterbi training from :func:`seeds`: lines the rules cannot name take the most likely state, at a third of the weight."""
    plain = seeds(codes)
    ones = np.ones(len(codes))
    stay = np.log(np.full((STATES, STATES), 0.08 / (STATES - 1)) * (1 - np.eye(STATES)) + np.eye(STATES) * 0.92)
    model = LineModel(known, fluency, _emissions(codes, plain, ones), stay, np.log(np.full(STATES, 1 / STATES)))
    first = np.zeros(len(codes), bool)
    first[starts[lengths > 0]] = True
    for _ in range(rounds):
        state = viterbi(model.scores(codes), starts, lengths, model.transition, model.start)
        emission = _emissions(codes, np.where(plain >= 0, plain, state), np.where(plain >= 0, 1.0, 1 / 3))
        moves = np.ones((STATES, STATES)) + np.eye(STATES) * 10
        inside = ~first[1:]
        np.add.at(moves, (state[:-1][inside], state[1:][inside]), 1.0)
        begun = 1.0 + np.bincount(state[first], minlength=STATES)
        model = LineModel(known, fluency, emission, np.log(moves / moves.sum(1, keepdims=True)), np.log(begun / begun.sum()))
    return model


def _runs(doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.bincount(doc, minlength=docs)
    return np.cumsum(lengths) - lengths, lengths


def _slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of texts of about :data:`SLICE` bytes; a longer text is a run of its own."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = min(max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, side="right")) - 1), len(texts))
        yield i, j, data, offsets[i : j + 1]
        i = j


STATS = pa.schema(
    [("id", pa.int64()), *((n, pa.int64()) for n in ("n_chars", "n_words", "n_lines")), *((n, pa.float64()) for n in ("mean_word_length", "symbol_ratio", "punct_line_share", "common_word_share")), *((f"{k}_share", pa.float64()) for k in KINDS)]
)


def _statistics(known: L.Words, model: LineModel | None):
    """Rows of :data:`STATS`, without shares of kinds if there is no model."""
    kinds = KINDS if model else ()
    schema = pa.schema(list(STATS)[: len(STATS) - len(KINDS) + len(kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in _slices(batch.column("text")):
                docs = j - i
                lines = L.measure(data, offsets, known)
                starts, lengths = _runs(lines.doc, docs)
                if model:
                    scores = model.scores(L.codes(lines, model.fluency))
                    kind = KIND_OF[viterbi(scores, starts, lengths, model.transition, model.start)]
                total = lambda x: np.bincount(lines.doc, weights=x, minlength=docs)  # noqa: E731, B023
                c = lines.counts
                letters = total(c[:, L.LOWER] + c[:, L.UPPER] + c[:, L.LETTER2])  # each letter has one such byte
                chars, words = total(lines.chars), total(lines.words)
                letters_and_digits = letters + total(c[:, L.DIGIT])
                ends = (lines.last & 255 == L.STOP) | (lines.last >> 8 == ord(":")) | (lines.last >> 8 == ord(";"))
                one = lambda a, b: np.where(b > 0, a / np.maximum(b, 1), 0.0)
                shares = [one(total(np.where(kind == k, lines.chars, 0)), chars) for k in range(len(kinds))]
                columns = [batch.column("id").slice(i, docs), chars.astype(np.int64), words.astype(np.int64), lengths]
                columns += [one(letters, words), np.clip(one(chars - letters_and_digits, chars), 0.0, 1.0), one(total(ends), lengths), one(total(lines.common), words), *shares]
                yield pa.record_batch([pa.array(x) if isinstance(x, np.ndarray) else x for x in columns], schema=schema)

    return run


def _pair_counts(known: L.Words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for _, _, data, offsets in _slices(batch.column("text")):
                pairs, n = np.unique(L.measure(data, offsets, known).pairs, return_counts=True)
                at, where = np.unique(np.concatenate([at, pairs]), return_inverse=True)
                counts = np.bincount(where, weights=np.concatenate([counts, n]), minlength=len(at)).astype(np.int64)
        yield pa.record_batch([pa.array(at), pa.array(counts)], names=["pair", "n"])

    return run


def _line_codes(known: L.Words, fluency: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in _slices(batch.column("text")):
                lines = L.measure(data, offsets, known)
                codes = L.codes(lines, fluency)
                starts, lengths = _runs(lines.doc, j - i)
                packed = [codes[s : s + n].tobytes() for s, n in zip(starts, lengths, strict=True)]
                yield pa.record_batch([batch.column("id").slice(i, j - i), pa.array(packed, pa.binary())], names=["id", "codes"])

    return run


def fit(documents: DataFrame, doc_id: str, text: str, words: list[str], sample: int = 3000) -> LineModel:
    """Train the model on about ``sample`` documents, chosen by the hash of their id.

    Viterbi training depends on the bound ``sample``; pairs of words are counted, and lines measured, in every document.
    """
    known = L.Words.of(words)
    total = documents.count()
    held = documents.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    n = len(known) + 1
    pairs = held.select("text").mapInArrow(_pair_counts(known), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    counts = np.full(n * n, 0.1)
    counts[np.array([r["pair"] for r in pairs], np.int64)] += [r["n"] for r in pairs]
    counts = counts.reshape(n, n)
    if total > sample:  # the limit holds the bound where many rows have the same id
        held = held.where(F.pmod(F.xxhash64("id"), F.lit(2**62)) < int(2**62 * sample / total)).limit(2 * sample)
    fluency = np.log(counts / counts.sum(1, keepdims=True)).ravel()
    rows = sorted(held.mapInArrow(_line_codes(known, fluency), "id long, codes binary").collect(), key=lambda r: (r["id"] is None, r["id"] or 0, r["codes"]))
    codes = [np.frombuffer(r["codes"], np.uint8).reshape(-1, len(L.FEATURES)) for r in rows]
    lengths = np.array([len(c) for c in codes], np.int64)
    stacked = np.concatenate(codes) if codes else np.zeros((0, len(L.FEATURES)), np.uint8)
    return train(stacked, np.cumsum(lengths) - lengths, lengths, known, fluency)


def text_statistics(documents: DataFrame, doc_id: str, text: str, words: DataFrame, word: str = "word", sample: int = 3000) -> DataFrame:
    """One row per document with its statistics and the shares of its characters in lines of each kind.

    (doc id, n_chars, n_words, n_lines, mean_word_length, symbol_ratio, punct_line_share,
    common_word_share, prose_share, list_share, table_share, junk_share, is_prose). Characters are
    those that are not white space, lines those that are not blank. Words are runs of letters.
    Common words are those of any language in ``words``, a fixed list of at most 4,000.
    ``is_prose`` is false if more than half of the characters are not in prose lines. A null or
    blank text has zeros and a null ``is_prose``. Repeated documents each have their row; other
    columns are ignored. Texts are processed whole.
    """
    known = _word_list(words, word)
    model = fit(documents, doc_id, text, known, sample)
    held = documents.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    stats = held.mapInArrow(_statistics(model.known, model), PLAIN_SCHEMA + ", " + ", ".join(f"{k}_share double" for k in KINDS))
    not_prose = F.col("list_share") + F.col("table_share") + F.col("junk_share") > 0.5
    return stats.withColumn("is_prose", F.when(F.col("n_chars") > 0, ~not_prose)).withColumnRenamed("id", doc_id)


PLAIN_SCHEMA = "id long, n_chars long, n_words long, n_lines long, mean_word_length double, symbol_ratio double, punct_line_share double, common_word_share double"


def plain_statistics(documents: DataFrame, doc_id: str, text: str, words: DataFrame, word: str = "word") -> DataFrame:
    """The statistics of :func:`text_statistics` that need no model; nothing is trained."""
    known = L.Words.of(_word_list(words, word))
    held = documents.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    return held.mapInArrow(_statistics(known, None), PLAIN_SCHEMA).withColumnRenamed("id", doc_id)


def _word_list(words: DataFrame, word: str) -> list[str]:
    rows = words.select(F.lower(F.col(f"`{word}`")).alias("w")).where("w is not null").distinct().limit(4_001).collect()
    if len(rows) > 4_000:
        raise ValueError("more than 4,000 common words")
    return [r["w"] for r in rows]
