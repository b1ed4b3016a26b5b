"""Mixing sources to target shares by soft membership.

Every document belongs to the sources with some probability: a labelled one to its source, any
other by a classifier that is trained on labelled documents. Documents get rates (expected numbers
of uses) such that the expected tokens of each source match its target: nonnegative least squares by
projected gradient. Each step needs one sum per source over all documents. The rates are then
rounded to whole repeats without losing the totals.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.packing import with_shards
from pairloom.llm.tokens import VOCABULARY, encoder
from pairloom.sources.scratch import materialize


def source_name(column: Column) -> Column:
    """A source in lower case without outer blanks, hyphens and blanks within as one underscore; null if empty."""
    name = F.regexp_replace(F.lower(F.trim(column)), r"[\s_-]+", "_")
    return F.when(name != "", name)


@dataclass(frozen=True)
class Classifier:
    """Multinomial naive Bayes on tokens: log probabilities by token and source, of sources, and the sharpness of posteriors.

    A text's tokens weigh as ``sharpness`` * their number ** (1 - ``damping``) independent ones: tokens of a text depend on each other.
    """

    tokens: np.ndarray
    prior: np.ndarray
    sharpness: float
    damping: float = 0.0

    def posterior(self, ids: np.ndarray) -> np.ndarray:
        score = self.prior + self.sharpness * len(ids) ** -self.damping * self.tokens[ids].sum(0) if len(ids) else self.prior.copy()
        score = np.exp(score - score.max())
        return score / score.sum()


def _tokens_of(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_to_numpy
        for batch in batches:
            packed = [encode(t.as_py() or "", disallowed_special=()).astype(np.int32).tobytes() for t in batch.column("text")]
            yield pa.record_batch([batch.column("label"), pa.array(packed, pa.binary())], names=["label", "tokens"])

    return run


#: Sharpness and damping that are tried: none, and a few tokens' to all tokens' worth at full length, by the root of it, and at any length.
TRIED = ((0.0, 0.0), *((2.0**-k, 0.0) for k in range(16)), *((2.0**k, 0.5) for k in range(-8, 4)), *((2.0 ** (k / 2), 1.0) for k in range(-6, 17)))


def train(labels: np.ndarray, texts: list[np.ndarray], sources: int, size: int, held: np.ndarray | None = None) -> Classifier:
    """Fit on two thirds of the texts; sharpness and damping are those with the least log loss on the others. A source without texts gets no mass.

    ``held`` has the number of texts of each source in all, if these are a sample. Copies of a text are on one side of the split.
    """
    held = np.bincount(labels, minlength=sources).astype(float) if held is None else held
    with np.errstate(divide="ignore"):
        prior = np.log(held / held.sum()) if held.sum() else np.full(sources, -math.log(max(sources, 1)))

    def fit(rows):
        at = np.concatenate([texts[i].astype(np.int64) * sources + labels[i] for i in rows]) if len(rows) else np.zeros(0, np.int64)
        counts = np.bincount(at, minlength=size * sources).reshape(size, sources) + 0.1
        return np.log(counts / counts.sum(0)).astype(np.float32)

    order = np.arange(len(texts))
    seen: dict[bytes, int] = {}
    part = np.array([seen.setdefault(t.tobytes(), len(seen)) % 3 for t in texts], np.int64)
    tokens = fit(order[part > 0])
    tests = order[part == 0]
    sums = np.array([tokens[texts[i]].sum(0) for i in tests]).reshape(-1, sources)
    lengths = np.array([max(len(texts[i]), 1) for i in tests], float)[:, None]

    def loss(tried):
        score = prior + tried[0] * lengths ** -tried[1] * sums
        top = score.max(1, keepdims=True)
        return float((np.log(np.exp(score - top).sum(1)) + top[:, 0] - score[np.arange(len(tests)), labels[tests]]).mean()) if len(tests) else 0.0

    return Classifier(fit(order), prior, *min(TRIED, key=loss))


def fit_classifier(documents: DataFrame, sources: list[str], doc_id: str, text: str, label: str, sample: int = 3000, vocabulary: str = VOCABULARY) -> Classifier:
    """Train on about ``sample`` labelled documents, chosen by the hash of their id and text. ``label`` is a column of source names.

    The prior of the sources is counted over all labelled documents.
    """
    number = F.array_position(F.array(*[F.lit(s) for s in sources]), F.col(label)) - 1
    held = documents.select(number.cast("int").alias("label"), F.col(doc_id).alias("id"), F.col(text).alias("text")).where("label >= 0 and text is not null")
    counts = np.zeros(len(sources))
    for r in held.groupBy("label").count().collect():
        counts[r["label"]] = r["count"]
    total = counts.sum()
    if total > sample:  # the limit holds the bound where many rows have the same id and text
        held = held.where(F.pmod(F.xxhash64("id", "text"), F.lit(2**62)) < int(2**62 * sample / total)).limit(2 * sample)
    rows = held.select("label", "text").mapInArrow(_tokens_of(vocabulary), "label int, tokens binary").collect()
    rows.sort(key=lambda r: (r["tokens"], r["label"]))
    rows = [rows[i] for i in np.random.default_rng(0).permutation(len(rows))]
    return train(np.array([r["label"] for r in rows], np.int64), [np.frombuffer(r["tokens"], np.int32) for r in rows], len(sources), encoder(vocabulary).n_vocab, counts)


#: Memberships are whole multiples of one part in so many, so each is off by less than that and documents alike share a rate.
PARTS = 64
#: Steps of the gradient after which the rates are written.
WRITE_EVERY = 10


def quantised(posterior: np.ndarray) -> np.ndarray:
    """The posterior in multiples of 1 / :data:`PARTS` that sum to 1; what is cut off goes where most was cut, first to the first."""
    whole = np.floor(posterior * PARTS + 1e-9)
    order = np.lexsort((np.arange(len(posterior)), -np.round(posterior * PARTS - whole, 9)))
    whole[order[: max(0, round(PARTS - whole.sum()))]] += 1
    return whole / PARTS


def _measured(model: Classifier, vocabulary: str):
    sources = model.tokens.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_to_numpy
        for batch in batches:
            known = batch.column("label").to_pylist()
            counts, shares = [], []
            for t, label in zip(batch.column("text"), known, strict=True):
                ids = encode(t.as_py() or "", disallowed_special=())
                counts.append(len(ids))
                if label is None:
                    shares.append(quantised(model.posterior(ids)).tolist())
                else:
                    shares.append([1.0 if i == label else 0.0 for i in range(sources)])
            yield pa.record_batch([batch.column("id"), batch.column("label"), pa.array(counts, pa.int64()), pa.array(shares, pa.list_(pa.float64()))], names=["id", "label", "n_tokens", "member"])

    return run


def fit_rates(groups: DataFrame, targets: np.ndarray, caps: np.ndarray, total: float | None, steps: int = 60, tolerance: float = 1e-6) -> tuple[list[list[float]], float]:
    """The steps of the projected gradient, and the total they aim at.

    ``groups`` has the distinct memberships (member) with their tokens: documents that belong alike
    have the same rate. A rate starts at 0 and is moved by the dot product of a step with the membership,
    then kept between 0 and its cap. A step is the error of each source over its tokens, which is the
    gradient in the metric of the documents' sizes. Rates are a column that is written every few steps, so
    the work of a step stays the same.
    """
    n = len(targets)
    cap = dot(caps)
    sums = lambda rate: [F.sum(F.col("tokens") * F.get("member", F.lit(i)) * rate) for i in range(n)]
    held = np.array([x or 0.0 for x in groups.agg(*sums(F.lit(1.0))).first()], float) if n else np.zeros(0)
    open_ = (held > 0) & (targets > 0)
    if total is None:
        total = float(min((caps[i] * held[i] / targets[i] for i in np.flatnonzero(open_)), default=0.0))
    taken: list[list[float]] = []
    last = np.full(n, np.inf)
    rated = groups.withColumn("rate", F.lit(0.0))
    for _ in range(steps if n else 0):
        fresh = taken[len(taken) // WRITE_EVERY * WRITE_EVERY :]
        if taken and not fresh:
            rated = materialize(rated.withColumn("rate", rate_of(taken[-WRITE_EVERY:], cap, F.col("rate"))))
        got = np.array([x or 0.0 for x in rated.agg(*sums(rate_of(fresh, cap, F.col("rate")))).first()], float)
        error = np.where(open_, targets * total - got, -got)
        step = np.divide(error, held, out=np.zeros(n), where=held > 0)
        # Done when all targets are met, or when those that are not cannot be: nothing moves any more.
        if min(np.abs(error).max(initial=0.0), np.abs(error - last).max(initial=0.0)) <= tolerance * max(total, 1.0):
            break
        last = error
        taken.append(step.tolist())
    return taken, total


def dot(values: np.ndarray) -> Column:
    """The dot product of the membership with ``values``."""
    held = F.array(*[F.lit(float(x)) for x in values]).cast("array<double>")
    return F.aggregate(F.zip_with("member", held, lambda m, x: m * x), F.lit(0.0), lambda a, x: a + x)


def rate_of(taken: list[list[float]], cap: Column, start: Column | None = None) -> Column:
    """The rate of a row with ``member`` after the given steps from ``start`` (0)."""
    start = F.lit(0.0) if start is None else start
    if not taken:
        return start
    steps = F.array(*[F.array(*[F.lit(float(x)) for x in g]) for g in taken])
    move = lambda g: F.aggregate(F.zip_with("member", g, lambda m, x: m * x), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(steps, start, lambda r, g: F.greatest(F.lit(0.0), F.least(cap, r + move(g))))


def whole_repeats(sizes: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Whole numbers next to ``rates`` whose sum, weighted by the sizes, stays as near as can be. Largest sizes first."""
    out = np.floor(rates + 1e-9).astype(np.int64)
    left = np.clip(rates - out, 0.0, 1.0)
    owed = 0.0
    for i in np.argsort(-sizes, kind="stable").tolist():
        owed += left[i] * sizes[i]
        if sizes[i] and left[i] > 1e-9 and owed >= sizes[i] / 2:
            out[i] += 1
            owed -= sizes[i]
    return out


def mix(documents: DataFrame, doc_id: str, text: str, source: str, targets: DataFrame, total_tokens: float | None = None, sample: int = 3000, shard_docs: int = 50_000, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The chosen documents with their repeats, and the shares reached.

    ``targets`` is (source, target_share, max_repeats), a fixed list of at most 1,000 sources. Names
    are compared as by :func:`source_name`. First result: (doc id, source, labelled, n_tokens,
    repeats), one row per chosen document; no document is used more than ``max_repeats`` of its
    source. A document without a source belongs to the sources softly and is reported under the
    likeliest. Documents of sources without a target, and those without tokens, are not chosen. Second
    result: (source, target_share, n_documents, n_tokens, share), one row per target, sources without
    documents with 0. Without ``total_tokens`` the mix is as large as the scarcest source allows. An
    empty table gives no chosen documents.
    """
    wanted = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null")
    rows = sorted(wanted.limit(1001).collect(), key=lambda r: r["source"])
    if len(rows) > 1000:
        raise ValueError("more than 1,000 targets")
    names = [r["source"] for r in rows]
    shares, caps = np.array([r["target_share"] or 0.0 for r in rows]), np.array([float(r["max_repeats"] or 0) for r in rows])
    held = documents.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"), source_name(F.col(f"`{source}`")).alias("name"))
    model = fit_classifier(held, names, "id", "text", "name", sample, vocabulary)
    number = (F.array_position(F.array(*[F.lit(s) for s in names]), F.col("name")) - 1).cast("int")
    label = F.when(F.col("name").isNotNull(), number)
    measured = held.select("id", "text", label.alias("label")).where("label is null or label >= 0")
    known = materialize(measured.mapInArrow(_measured(model, vocabulary), "id long, label int, n_tokens long, member array<double>").where("n_tokens > 0"))
    groups = materialize(known.groupBy("member").agg(F.sum("n_tokens").alias("tokens")))
    taken, _ = fit_rates(groups, shares, caps, total_tokens)
    likeliest = F.coalesce("label", (F.array_position("member", F.array_max("member")) - 1).cast("int"))
    rated = known.select("id", "label", "n_tokens", likeliest.alias("at"), rate_of(taken, dot(caps)).alias("rate")).where("rate > 0")
    most = F.get(F.array(*[F.lit(x) for x in caps.tolist()]), F.col("at"))
    shards = max(1, math.ceil(known.count() / shard_docs))
    rated = with_shards(rated.withColumn("rate", F.least("rate", most)), shards)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n_tokens", "id"], kind="stable", ignore_index=True)
        repeats = np.zeros(len(frame), np.int64)
        for at in frame["at"].unique():
            mine = np.flatnonzero(frame["at"] == at)
            repeats[mine] = whole_repeats(frame["n_tokens"].to_numpy()[mine], frame["rate"].to_numpy()[mine])
        return frame.assign(repeats=repeats).loc[repeats > 0, ["id", "at", "labelled", "n_tokens", "repeats"]]

    rated = rated.withColumn("labelled", F.col("label").isNotNull()).drop("label")
    chosen = materialize(rated.groupBy("shard").applyInPandas(run, "id long, at int, labelled boolean, n_tokens long, repeats long"))
    name = F.get(F.array(*[F.lit(s) for s in names]), F.col("at")) if names else F.lit(None).cast("string")
    chosen = chosen.select(F.col("id").alias(doc_id), name.alias("source"), "labelled", "n_tokens", "repeats")
    sums = chosen.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("n_tokens"))
    all_tokens = sums.agg(F.sum("n_tokens").alias("all"))
    reached = F.broadcast(wanted.select("source", "target_share")).join(sums, "source", "left").crossJoin(F.broadcast(all_tokens))
    none = lambda c: F.coalesce(c, F.lit(0))
    return chosen, reached.select("source", "target_share", none(F.col("n_documents")).alias("n_documents"), none(F.col("n_tokens")).alias("n_tokens"), F.coalesce(F.col("n_tokens") / F.col("all"), F.lit(0.0)).alias("share"))
