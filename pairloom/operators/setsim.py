"""Set-similarity joins by prefix, length and positional filters.

Tokens are ordered by rarity. Two sets that are similar enough must share a token within the first
few of each (how many follows from size and threshold), their sizes must be alike, the shared token
must not stand so late that too few can follow, and hashed bitmaps of the two sets must leave room
for the overlap: a bit that only one has is a token that only one has. Only pairs that pass are verified.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.skew import MOST_PAIRS, block_join, lookup_skewed
from pairloom.sources.scratch import is_dry, materialize, open_folder

#: Guards bounds on counts against rounding; far below 1 and far above the error of a double.
EPS = 1e-9
SIMS = ("jaccard", "cosine")
#: The bitmap of a set, in words of 64 bits.
BITMAP = ("b0", "b1", "b2", "b3")
#: Tokens that are ranked in one pass over the vocabulary, and tokens of the vocabulary that are met at a time.
PASS, WORDS = 2_000_000, 500_000
#: Prefix tokens that are shuffled at a time: so many for each set, but not fewer than so many in all.
PER_SET, LEAST_ROUND = 4, 1_000_000


def _check(sim: str, threshold: float) -> None:
    if sim not in SIMS:
        raise ValueError(f"unknown similarity {sim}, choose from {SIMS}")
    if not 0.0 < threshold <= 1.0:
        raise ValueError("an indexed similarity needs a threshold in (0, 1]")


def score_of(sim: str, overlap: Column, n1: Column, n2: Column) -> Column:
    """The similarity of two sets by their overlap and sizes; 0.0 if either is empty."""
    if sim == "jaccard":
        score = overlap / (n1 + n2 - overlap)
    elif sim == "cosine":
        score = overlap / F.sqrt((n1 * n2).cast("double"))
    else:
        score = overlap / F.least(n1, n2)
    return F.when((n1 == 0) | (n2 == 0), F.lit(0.0)).otherwise(score)


def least_ratio(sim: str, threshold: float) -> float:
    """The least ratio of the smaller to the larger size of two similar sets."""
    return threshold if sim == "jaccard" else threshold * threshold


def least_overlap(sim: str, threshold: float, n1: Column, n2: Column) -> Column:
    """The least overlap two similar sets of these sizes have."""
    if sim == "jaccard":
        return F.ceil((n1 + n2) * (threshold / (1.0 + threshold)) - EPS)
    return F.ceil(F.sqrt((n1 * n2).cast("double")) * threshold - EPS)


def ranked_tokens(sets: DataFrame) -> DataFrame:
    """(tok, df, rank) of the tokens of ``sets`` (…, toks): the number of sets with the token, and numbers in order of (df, tok).

    It is written once. The ranks have gaps; a rarer token has the lower one.
    """
    counts = sets.select(F.explode("toks").alias("tok")).groupBy("tok").agg(F.count("*").alias("df"))
    return materialize(counts.orderBy("df", "tok").withColumn("rank", F.monotonically_increasing_id()))


def rarity_ordered(sets: DataFrame, bitmap: bool = True, ranks: DataFrame | None = None) -> DataFrame:
    """``sets`` (side, sid, toks) with ``toks`` as ascending token ranks, rarest first, their number ``n``, and, if asked, a bitmap.

    ``ranks`` are those of another table, if the sets are to be compared with that one: tokens that it
    does not have come first, under negative numbers, as they meet nothing. The bitmap pays where sets are
    large and many candidates fail, as with q-grams. A token in very many sets is looked up without being
    gathered in one task.
    """
    if ranks is None:
        return _by_rank(sets, ranked_tokens(sets), bitmap)
    here = sets.select(F.explode("toks").alias("tok")).groupBy("tok").agg(F.count("*").alias("df"))
    return _by_rank(sets, here.join(ranks.select("tok", "rank"), "tok", "left"), bitmap)


def _by_rank(sets: DataFrame, known: DataFrame, bitmap: bool) -> DataFrame:
    """``known`` (tok, df, rank) has every token of ``sets`` with its number of sets."""
    rows = sets.select("side", "sid", F.explode("toks").alias("tok"))
    total = known.agg(F.sum("df").alias("all"))
    found = lookup_skewed(rows, known.crossJoin(F.broadcast(total)), "tok", "df", F.col("all"))
    rank = F.coalesce(F.col("rank"), -1 - F.shiftrightunsigned(F.xxhash64("tok"), 1))
    at = F.pmod(F.xxhash64("tok"), F.lit(64 * len(BITMAP)))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))
    words = [F.bit_or(F.when(F.floor(at / 64) == i, bit).otherwise(F.lit(0).cast("long"))).alias(b) for i, b in enumerate(BITMAP if bitmap else ())]
    out = found.groupBy("side", "sid").agg(F.array_sort(F.collect_list(rank)).alias("toks"), *words)
    return out.select("side", "sid", "toks", F.size("toks").alias("n"), *BITMAP[: len(words)])


def _ranker(path: str):
    """Rows (sid, toks) become (side, sid, toks, n, b0, …) as of :func:`rarity_ordered`, by the vocabulary (tok, rank) of a Parquet folder."""

    def ranked(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        toks = pa.concat_arrays(rows["toks"].chunks)
        length = pc.fill_null(pc.list_value_length(toks), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        words = toks.flatten().dictionary_encode()
        rank = -1 - np.arange(len(words.dictionary))  # of those that the vocabulary does not have
        for part in open_folder(path).to_batches(columns=["tok", "rank"], batch_size=WORDS) if len(rank) else ():
            at = pc.index_in(part.column("tok"), words.dictionary)
            known = pc.is_valid(at)
            rank[at.filter(known).to_numpy(zero_copy_only=False)] = part.column("rank").filter(known).to_numpy(zero_copy_only=False)
        code, row = rank[words.indices.to_numpy(zero_copy_only=False)], np.repeat(np.arange(len(length)), length)
        order = np.lexsort((code, row))
        code = code[order]
        # Equal tokens that both sides know have equal ranks, hence equal bits.
        bit = (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 8)
        maps = np.zeros((len(length), len(BITMAP)), np.uint64)
        np.bitwise_or.at(maps, (row, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
        some = np.flatnonzero(length)
        ends = np.concatenate([[0], np.cumsum(length[some])])
        sid = rows["sid"].to_numpy()[some]
        for a in range(0, len(some), 10_000):
            b = min(a + 10_000, len(some))
            held = pa.ListArray.from_arrays(pa.array(ends[a : b + 1] - ends[a], pa.int32()), pa.array(code[ends[a] : ends[b]]))
            n = length[some[a:b]].astype(np.int32)
            arrays = [pa.array(np.ones(b - a, np.int32)), pa.array(sid[a:b]), held, pa.array(n), *[pa.array(maps[some[a:b], i].view(np.int64)) for i in range(len(BITMAP))]]
            yield pa.record_batch(arrays, names=["side", "sid", "toks", "n", *BITMAP])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        tokens = records = 0
        for rows in batches:
            if not rows.num_rows:
                continue
            held.append(rows)
            records += rows.num_rows
            tokens += pc.sum(pc.list_value_length(rows.column("toks"))).as_py() or 0
            if tokens >= PASS or records >= PASS:
                yield from ranked(pa.Table.from_batches(held))
                held, tokens, records = [], 0, 0
        if held:
            yield from ranked(pa.Table.from_batches(held))

    return run


def _ranked(sets: DataFrame, ranks: DataFrame) -> DataFrame:
    """As :func:`rarity_ordered` of ``sets`` (sid, toks) by written ``ranks``, without empty sets. Each task reads the ranks: nothing is shuffled."""
    files = [] if is_dry() else ranks.inputFiles()
    kinds = ", ".join(["side int, sid long, toks array<long>, n int", *[f"{b} long" for b in BITMAP]])
    return sets.select(F.col("sid").cast("long").alias("sid"), "toks").mapInArrow(_ranker(files[0].rsplit("/", 1)[0] if files else ""), kinds)


def _bitmap(ordered: DataFrame) -> list[str]:
    return [b for b in BITMAP if b in ordered.columns]


def _prefix(sim: str, threshold: float) -> Column:
    """How many of a set's first tokens are looked at."""
    return F.least(F.col("n"), F.col("n") - F.ceil(F.col("n") * least_ratio(sim, threshold) - EPS).cast("int") + 1)


def _postings(ordered: DataFrame, sim: str, threshold: float, part: tuple[int, int]) -> DataFrame:
    ratio = least_ratio(sim, threshold)
    out = ordered.select("sid", "n", *_bitmap(ordered), F.posexplode(F.slice("toks", 1, _prefix(sim, threshold))).alias("pos", "tok"))
    out = out.where("tok >= 0")  # others meet nothing
    if part[1] > 1:
        out = out.where(F.pmod(F.xxhash64("tok", F.lit("part")), F.lit(part[1])) == part[0])
    if ratio >= 1.0:
        return out.withColumn("band", F.col("n"))
    # Similar sets lie in the same or in neighbouring bands of sizes.
    return out.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / math.log((1.0 + 1e-6) / ratio)).cast("int"))


def _room(sim: str, threshold: float) -> Column:
    """Whether the bitmaps x… and y… of a pair leave room for the overlap it needs."""
    own = lambda a, b: sum((F.bit_count(F.col(f"{a}{w}").bitwiseAND(F.bitwise_not(f"{b}{w}"))) for w in BITMAP), F.lit(0))
    return F.least(F.col("n1") - own("x", "y"), F.col("n2") - own("y", "x")) >= least_overlap(sim, threshold, F.col("n1"), F.col("n2"))


def candidates(left: DataFrame, right: DataFrame | None, sim: str, threshold: float, most: int = MOST_PAIRS, part: tuple[int, int] = (0, 1)) -> DataFrame:
    """(s1, s2) of rarity-ordered sets that pass all filters; within ``left`` (s1 < s2) if ``right`` is None.

    A token and band that makes more than ``most`` pairs is joined in blocks. ``part`` (i, of n) are the pairs
    that meet in the tokens of one of n hash parts.
    """
    near, far = _postings(left, sim, threshold, part), _postings(left if right is None else right, sim, threshold, part)
    steps = [0] if least_ratio(sim, threshold) >= 1.0 else [-1, 0] if right is None else [-1, 0, 1]
    x = near.select(F.col("sid").alias("s1"), F.col("n").alias("n1"), F.col("pos").alias("p1"), F.xxhash64("tok", "band").alias("key"), *[F.col(b).alias(f"x{b}") for b in _bitmap(near)])
    y = far.withColumn("band", F.explode(F.array(*[F.col("band") + s for s in steps])))
    y = y.select(F.col("sid").alias("s2"), F.col("n").alias("n2"), F.col("pos").alias("p2"), F.xxhash64("tok", "band").alias("key"), *[F.col(b).alias(f"y{b}") for b in _bitmap(far)])
    follow = F.least(F.col("n1") - F.col("p1"), F.col("n2") - F.col("p2"))
    ratio = least_ratio(sim, threshold)
    alike = (F.least("n1", "n2") >= F.greatest("n1", "n2") * ratio - EPS) & (follow >= least_overlap(sim, threshold, F.col("n1"), F.col("n2")))
    if _bitmap(near) and _bitmap(far):
        alike &= _room(sim, threshold)
    if right is None:  # each pair once, from the side of the larger set
        alike &= (F.col("n1") < F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("s1") < F.col("s2")))
    # Two tokens under one hash give candidates too many, which fail the exact test.
    met = block_join(x, y, "key", most).where(alike)
    if right is None:
        return met.select(F.least("s1", "s2").alias("s1"), F.greatest("s1", "s2").alias("s2")).distinct()
    return met.select("s1", "s2").distinct()


def verified(pairs: DataFrame, left: DataFrame, right: DataFrame, sim: str, threshold: float, strict: bool = False) -> DataFrame:
    """(s1, s2, score) of the candidate pairs whose exact similarity reaches the threshold."""
    x = left.select(F.col("sid").alias("s1"), F.col("toks").alias("t1"))
    y = right.select(F.col("sid").alias("s2"), F.col("toks").alias("t2"))
    both = pairs.join(x, "s1").join(y, "s2")
    score = score_of(sim, F.size(F.array_intersect("t1", "t2")), F.size("t1"), F.size("t2"))
    scored = both.select("s1", "s2", score.alias("score"))
    return scored.where(F.col("score") > threshold if strict else F.col("score") >= threshold)


@dataclass(frozen=True)
class SetIndex:
    """The sets of an index table, ordered by rarity, and the ranks of their tokens; both are written once."""

    ordered: DataFrame
    ranks: DataFrame


def set_index(sets: DataFrame) -> SetIndex:
    """An index of ``sets`` (sid, toks) that any number of search tables can be joined with."""
    ranks = ranked_tokens(sets)
    return SetIndex(materialize(_ranked(sets, ranks)), ranks)


def _rounds(left: DataFrame, right: DataFrame, sim: str, threshold: float) -> int:
    """Rounds of tokens that bound the postings which are shuffled at a time."""
    if is_dry():
        return 1
    (n1, p1), (n2, p2) = (x.agg(F.count("*"), F.coalesce(F.sum(_prefix(sim, threshold)), F.lit(0))).first() for x in (left, right))
    postings = p1 + p2 * (1 if least_ratio(sim, threshold) >= 1.0 else 3)
    return max(1, math.ceil(postings / max(LEAST_ROUND, PER_SET * (n1 + n2))))


def similarity_join(left: DataFrame | SetIndex, right: DataFrame, sim: str, threshold: float, strict: bool = False, most: int = MOST_PAIRS) -> DataFrame:
    """(s1, s2, score): pairs of ``left`` and ``right`` (sid, toks) with a similarity of ``threshold`` or more.

    ``toks`` are arrays without repeats; null and empty ones match nothing. ``strict`` asks for more
    than ``threshold``. The ordered sets and the candidates are written when this is called, the candidates in rounds of
    tokens: postings are much larger than the sets, so only those of one round are on disk at a time.
    """
    _check(sim, threshold)
    index = left if isinstance(left, SetIndex) else set_index(left)
    search = materialize(_ranked(right, index.ranks))
    rounds = _rounds(index.ordered, search, sim, threshold)
    found = [materialize(candidates(index.ordered, search, sim, threshold, most, (i, rounds))) for i in range(rounds)]
    pairs = found[0] if rounds == 1 else reduce(DataFrame.unionByName, found).distinct()  # some meet in several rounds
    return verified(pairs, index.ordered, search, sim, threshold, strict)
