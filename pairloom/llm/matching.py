"""Matching the records of two tables that share no key.

Each text attribute of a record becomes a bit vector of fixed length: every q-gram of its words sets
one bit, so order, notation and small errors change few bits. Close vectors are found by multi-index
Hamming hashing: a vector is cut into chunks, and two vectors that differ in fewer bits than there are
chunks agree in a whole chunk. All pairs that agree in one are compared, at every size of the tables, so
the search is exact within that distance. Dice similarities of the vectors then tell how alike
the attributes of a pair are; a mixture model, fitted to the patterns of all pairs without any
labels, weighs the attributes and gives each pair the probability that it is a match.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.skew import MOST_PAIRS, block_join
from pairloom.sources.scratch import materialize, outliving, scope


@dataclass(frozen=True)
class TextField:
    """An attribute to be encoded: its column in either table, the length of its vector, and what is done to its words.

    Vectors are looked up by ``chunks`` chunks, so all pairs that differ in fewer bits are compared; of the pairs
    compared those with a Dice similarity of ``dice`` are close. With ``near_number`` close means also that
    the records' numbers differ by at most one or one is unknown; for attributes that many records share.
    """

    name: str
    left: str
    right: str
    bits: int
    dice: float = 0.5
    short_forms: dict[str, str] = field(default_factory=dict, hash=False)
    near_number: bool = False
    chunks: int = 8

    @property
    def longs(self) -> int:
        return self.bits // 64

    def columns(self, side: str = "") -> list[str]:
        return [f"{side}{self.name}_{i}" for i in range(self.longs)]


def plain_words(texts: pa.Array, short_forms: dict[str, str]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of two or more letters or digits of all texts, without case and accents, short forms put in, and how many each text has."""
    flat = pc.utf8_normalize(pc.utf8_lower(pc.fill_null(texts, "")), "NFKD")
    bare = pc.replace_substring_regex(pc.replace_substring_regex(flat, r"\p{M}+", ""), r"[^\p{L}\p{N}]+", " ")
    lists = pc.utf8_split_whitespace(bare)
    owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    words = lists.flatten()
    long = pc.greater_equal(pc.utf8_length(words), 2)
    coded = words.filter(long).dictionary_encode()
    if short_forms:
        names = pa.array([short_forms.get(w, w) for w in coded.dictionary.to_pylist()], pa.string()).dictionary_encode()
        coded = pa.DictionaryArray.from_arrays(names.indices.take(coded.indices), names.dictionary)
    return coded, np.bincount(owner[long.to_numpy(zero_copy_only=False)], minlength=len(lists))


def word_mask(word: str, bits: int) -> int:
    """The bits of the word's q-grams: all runs of three characters of the word with a mark at either end."""
    marked = f"\x02{word}\x03"
    return reduce(lambda m, i: m | 1 << (zlib.crc32(marked[i : i + 3].encode()) % bits), range(len(marked) - 2), 0)


def signature(text: str | None) -> str | None:
    """The first and the last initial of a name of several words, or the first and last letter of an abbreviation; null if there are none."""
    flat = "".join(c for c in unicodedata.normalize("NFKD", (text or "").lower()) if not unicodedata.combining(c))
    words = [w for w in re.findall(r"[^\W_\d]+", flat) if w not in SIDE_WORDS]
    if not words:
        return None
    if all(len(w) <= 4 for w in words):
        return words[0][0] + words[0][-1]
    return words[0][0] + words[-1][0]


#: Words of a venue's name that its abbreviation leaves out, and additions to it.
SIDE_WORDS = frozenset("of on in for the and an proc proceedings vol no extended".split())


def _flat(column: pa.Array) -> pa.Array:
    return column.cast(pa.string())


def _split(fields: tuple[TextField, ...], side: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = []
            for f in fields:
                coded, n = plain_words(_flat(batch.column(f.name)), f.short_forms)
                words.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), coded.cast(pa.string())))
            labels = batch.column("label").dictionary_encode()
            known = pa.array([signature(t) for t in labels.dictionary.to_pylist()], pa.string())
            sides = pa.array(np.full(batch.num_rows, side, np.int32))
            yield pa.record_batch([sides, batch.column("id"), batch.column("number"), known.take(labels.indices), *words], names=["side", "id", "number", "label", *[f.name for f in fields]])

    return run


def _encode(fields: tuple[TextField, ...], common: dict[str, frozenset], endings: frozenset):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[dict[str, np.ndarray]] = [{} for _ in fields]

        def mask(f: TextField, masks: dict[str, np.ndarray], word: str) -> np.ndarray:
            held = masks.get(word)
            if held is None:
                bits = 0 if word in common[f.name] else word_mask(word, f.bits)
                held = masks[word] = np.frombuffer(bits.to_bytes(f.bits // 8, "little"), np.int64)
            return held

        for batch in batches:
            columns = [batch.column(n) for n in ("side", "id", "number", "label")]
            ending = [""] * batch.num_rows
            vectors = []
            for i, (f, masks) in enumerate(zip(fields, known, strict=True)):
                if len(masks) > 200_000:
                    masks.clear()
                lists = batch.column(f.name)
                n = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
                coded = lists.flatten().dictionary_encode()
                words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
                out = np.zeros((batch.num_rows, f.longs), np.int64)
                if len(codes):
                    table = np.array([mask(f, masks, w) for w in words], np.int64).reshape(len(words), f.longs)
                    begin = np.cumsum(n) - n
                    out[n > 0] = np.bitwise_or.reduceat(table[codes], begin[n > 0], axis=0)
                    if i == 0 and endings:
                        hit = np.array([w in endings for w in words])[codes]
                        owner = np.repeat(np.arange(batch.num_rows), n)
                        for row in np.unique(owner[hit]).tolist():
                            ending[row] = " ".join(sorted({words[c] for c in codes[begin[row] : begin[row] + n[row]] if words[c] in endings}))
                vectors += [pa.array(np.ascontiguousarray(out[:, k])) for k in range(f.longs)]
            yield pa.record_batch([*columns, pa.array(ending, pa.string()), *vectors], names=["side", "id", "number", "label", "ending", *[c for f in fields for c in f.columns()]])

    return run


def encoded(left: DataFrame, right: DataFrame, id_col: str, fields: tuple[TextField, ...], number: str, label: str, common_share: float = 0.05, ending_share: float = 0.0005) -> DataFrame:
    """(side, id, number, label, ending, bit vectors) of the records of both tables.

    ``ending`` has the words of the first field that mostly stand at its end: what is put behind the name of a
    work to tell its parts and editions apart. Such a word ends more than ``ending_share`` of the records, so
    there are fewer than 1 / ``ending_share``. Words that are surely (by three standard errors) in more than ``common_share`` of
    the records that have the field set no bits, as they are the frame of many texts. There are at most words-per-record / ``common_share`` of them.
    """

    def read(df, side, column):
        texts = [F.col(f"`{column(f)}`").cast("string").alias(f.name) for f in fields]
        rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{number}`").cast("int").alias("number"), F.col(f"`{label}`").cast("string").alias("label"), *texts)
        schema = "side int, id long, number int, label string, " + ", ".join(f"{f.name} array<string>" for f in fields)
        return rows.where("id is not null").mapInArrow(_split(fields, side), schema)

    words = materialize(read(left, 1, lambda f: f.left).unionByName(read(right, 2, lambda f: f.right)))
    common = {}
    for f in fields:
        held = words.where(F.size(f.name) > 0)
        least = held.count() * common_share
        counts = held.select(F.explode(F.array_distinct(f.name)).alias("w")).groupBy("w").count()
        common[f.name] = frozenset(r["w"] for r in counts.where(F.col("count") - 3.0 * F.sqrt("count") > least).collect())
    held = words.where(F.size(fields[0].name) > 1).select(F.col(fields[0].name).alias("w"))
    spread = held.select(F.posexplode("w").alias("i", "w"), F.size("w").alias("n")).groupBy("w")
    counts = spread.agg(F.count("*").alias("n"), F.count_if(F.col("i") == F.col("n") - 1).alias("last"))
    least = F.lit(held.count() * ending_share + 3.0)
    endings = frozenset(r["w"] for r in counts.where((F.col("last") > least) & (F.col("last") * 2 > F.col("n"))).collect())
    schema = "side int, id long, number int, label string, ending string, " + ", ".join(f"{c} long" for f in fields for c in f.columns())
    return words.mapInArrow(_encode(fields, common, endings), schema)


def ones(columns: list[Column]) -> Column:
    return reduce(Column.__add__, [F.bit_count(c) for c in columns])


def dice(f: TextField, left: str, right: str) -> Column:
    """The Dice similarity of two vectors; null if either is empty."""
    x, y = [F.col(c) for c in f.columns(left)], [F.col(c) for c in f.columns(right)]
    both = ones([a.bitwiseAND(b) for a, b in zip(x, y, strict=True)])
    nx, ny = ones(x), ones(y)
    return F.when((nx > 0) & (ny > 0), 2.0 * both / (nx + ny))


def _chunk(f: TextField, i: int) -> Column:
    """The bits of chunk ``i`` as a number; chunks are as equally wide as can be."""
    begin, end = f.bits * i // f.chunks, f.bits * (i + 1) // f.chunks
    if end - begin > 63:
        raise ValueError("a chunk has at most 63 bits")
    at = lambda k: F.col(f.columns()[k])
    out = F.shiftrightunsigned(at(begin // 64), begin % 64)
    if (end - 1) // 64 > begin // 64:
        out = out.bitwiseOR(F.call_function("shiftleft", at(end // 64), F.lit(64 - begin % 64)))
    return out.bitwiseAND(F.lit((1 << (end - begin)) - 1).cast("long"))


def _near_numbers() -> Column:
    """Values of which two records share exactly one if their numbers differ by at most one or either is unknown; pairs of numbers two apart may share one too."""
    n, left = F.col("number"), F.col("side") == 1
    two = lambda x: F.floor(x / 2).cast("int")
    any_left, any_right = F.lit(-(2**31) + 1), F.lit(-(2**31) + 2)
    one = F.when(n.isNull(), F.array(any_left, any_right)).otherwise(F.array(two(n), any_right))
    other = F.when(n.isNull(), F.array(any_right)).otherwise(F.array_distinct(F.array(two(n - 1), two(n + 1), any_left)))
    return F.when(left, one).otherwise(other)


def close_pairs(records: DataFrame, f: TextField, most: int = MOST_PAIRS) -> DataFrame:
    """(s1, s2) of records of the two sides whose vectors agree in a chunk and have the field's least similarity.

    ``records`` is (side, sid, number, vectors). All pairs that agree in a chunk are compared, so all
    close pairs that differ in at most ``chunks - 1`` bits are found. A chunk's value that makes more than ``most``
    pairs is compared in blocks of about that many. Empty vectors are close to nothing.
    """
    vector = f.columns()
    held = records.where(ones([F.col(c) for c in vector]) > 0)
    at = [F.struct(F.lit(i).alias("i"), _chunk(f, i).alias("v")) for i in range(f.chunks)]
    keep = ["side", "sid", *vector] + (["number"] if f.near_number else [])
    near = F.explode(_near_numbers()) if f.near_number else F.lit(0)
    keyed = held.select(*keep, near.alias("near")).select(*keep, "near", F.explode(F.array(*at)).alias("c"))
    keyed = keyed.withColumn("key", F.xxhash64("c.i", "c.v", "near"))
    side = lambda which, name, prefix: keyed.where(f"side = {which}").select("key", F.col("sid").alias(name), *[F.col(c).alias(f"{prefix}{c}") for c in keep[2:]])
    close = dice(f, "l_", "r_") >= f.dice - 1e-9
    if f.near_number:
        close &= F.coalesce(F.abs(F.col("l_number") - F.col("r_number")) <= 1, F.lit(True))
    return block_join(side(1, "s1", "l_"), side(2, "s2", "r_"), "key", most).where(close).select("s1", "s2")


@dataclass(frozen=True)
class MatchModel:
    """For each class (matches, works that continue each other, pairs alike in one text) its share and the log probabilities of each attribute's outcomes; class 0 are the matches."""

    share: np.ndarray
    tables: list[np.ndarray]

    def classes(self, patterns: np.ndarray) -> np.ndarray:
        """The probability of each class for rows of outcomes."""
        score = np.log(self.share) + sum(t[:, patterns[:, i]].T for i, t in enumerate(self.tables))
        score = np.exp(score - score.max(1, keepdims=True))
        return score / score.sum(1, keepdims=True)

    def posterior(self, names: list[str]) -> Column:
        """The probability of a match, from columns of outcomes."""
        at = lambda k, i: F.get(F.array(*[F.lit(float(x)) for x in self.tables[i][k]]), F.col(names[i]))
        score = [reduce(Column.__add__, [at(k, i) for i in range(len(names))], F.lit(float(np.log(self.share[k])))) for k in range(len(self.share))]
        return 1.0 / reduce(Column.__add__, [F.exp(x - score[0]) for x in score])


#: Distinct patterns that are fitted on the driver; more are fitted where they lie, by one sum over them per round.
DRIVER_PATTERNS = 1_000_000


def _start(first: np.ndarray, classes: int) -> np.ndarray:
    belong = np.full((len(first), classes), 1 / classes)
    told = first >= 0
    belong[told] = np.eye(classes)[first[told]] * 0.98 + 0.02 / classes
    return belong


def _sums(patterns: np.ndarray, counts: np.ndarray, belong: np.ndarray, sizes: list[int]) -> np.ndarray:
    """The weight of each class, then of each outcome of each attribute in each class, one after another."""
    # Pairs of which more is known are surer of their class: what is unknown lowers a pattern's say.
    say = belong * (counts * UNKNOWN_SAY ** (patterns == 0).sum(1))[:, None]
    classes = belong.shape[1]
    held = [np.bincount(patterns[:, i], weights=say[:, k], minlength=size) for i, size in enumerate(sizes) for k in range(classes)]
    return np.concatenate([(belong * counts[:, None]).sum(0), *held])


def _model(sums: np.ndarray, sizes: list[int], classes: int) -> MatchModel:
    share, at, tables = sums[:classes] + 1.0, classes, []
    for size in sizes:
        held = sums[at : at + classes * size].reshape(classes, size) + 0.1
        at += classes * size
        held[:, 0] = 0.0
        held /= held.sum(1, keepdims=True)
        held[:, 0] = 1.0  # unknown says nothing
        tables.append(np.log(held))
    return MatchModel(share / share.sum(), tables)


def fit_mixture(step, sizes: list[int], classes: int, rounds: int = 100) -> MatchModel:
    """Expectation maximisation; ``step(model)`` gives :func:`_sums` over all patterns by a model, or by the first classes for None."""
    model = _model(step(None), sizes, classes)
    for _ in range(rounds - 1):
        fresh = _model(step(model), sizes, classes)
        moved = max(np.abs(fresh.share - model.share).max(), *(np.abs(np.exp(x) - np.exp(y)).max() for x, y in zip(fresh.tables, model.tables, strict=True)))
        model = fresh
        if moved < 1e-7:
            break
    return model


def fit_patterns(table: DataFrame, names: list[str], sizes: list[int], texts: int, driver_patterns: int = DRIVER_PATTERNS) -> MatchModel:
    """Fit to ``table`` (outcomes, count), one row per distinct pattern."""
    classes = 2 + max(texts, 1)

    def sums(patterns: np.ndarray, counts: np.ndarray, model: MatchModel | None) -> np.ndarray:
        belong = _start(first_guess(patterns, texts), classes) if model is None else model.classes(patterns)
        return _sums(patterns, counts, belong, sizes)

    arrays = lambda t: (np.stack([t.column(n).to_numpy() for n in names], 1).astype(np.int64), t.column("count").to_numpy().astype(float))
    if table.count() <= driver_patterns:
        patterns, counts = arrays(table.toArrow())
        return fit_mixture(lambda model: sums(patterns, counts, model), sizes, classes)

    def far(model: MatchModel | None) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(classes + classes * sum(sizes))
            for batch in batches:
                total += sums(*arrays(batch), model)
            yield pa.record_batch([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

        return np.sum([r["sums"] for r in table.mapInArrow(run, "sums array<double>").collect()], axis=0)

    return fit_mixture(far, sizes, classes)


#: Outcomes of a similarity: unknown, then twentieths.
STEPS = 20
#: How much a pattern's weight in training is lowered by each unknown attribute.
UNKNOWN_SAY = 0.02
#: Bits that only one of two vectors has: few (an error), some (a word), many.
OWN_BITS = (4, 10)


def outcomes(fields: tuple[TextField, ...]) -> list[Column]:
    """The outcome of each attribute of a pair with columns l_… and r_…, as small numbers; 0 is unknown."""
    similar = [F.coalesce((F.floor(dice(f, "l_", "r_") * STEPS + 1e-9) + 1).cast("int"), F.lit(0)).alias(f"o{i}") for i, f in enumerate(fields)]
    gap = F.abs(F.col("l_number") - F.col("r_number"))
    number = F.when(gap.isNull(), 0).otherwise(F.least(gap, F.lit(3)) + 1).cast("int").alias(f"o{len(fields)}")
    label = F.coalesce(F.when(F.col("l_label") == F.col("r_label"), 1).otherwise(F.when(F.col("l_label").isNotNull() & F.col("r_label").isNotNull(), 2)), F.lit(0)).alias(f"o{len(fields) + 1}")
    ending = F.when(F.col("l_ending") == F.col("r_ending"), F.when(F.col("l_ending") == "", 1).otherwise(2)).otherwise(3)
    return [*similar, number, label, ending.cast("int").alias(f"o{len(fields) + 3}"), own_words(fields[0]).alias(f"o{len(fields) + 2}")]


def own_words(f: TextField) -> Column:
    """How much either vector of the field has that the other has not; Dice alone cannot tell lost words from other ones."""
    x, y = [F.col(c) for c in f.columns("l_")], [F.col(c) for c in f.columns("r_")]
    level = lambda n: F.when(n < OWN_BITS[0], 0).when(n < OWN_BITS[1], 1).otherwise(2)
    mine = level(ones([a.bitwiseAND(F.bitwise_not(b)) for a, b in zip(x, y, strict=True)]))
    other = level(ones([b.bitwiseAND(F.bitwise_not(a)) for a, b in zip(x, y, strict=True)]))
    return F.when((ones(x) > 0) & (ones(y) > 0), mine * 3 + other + 1).otherwise(0)


def first_guess(patterns: np.ndarray, texts: int) -> np.ndarray:
    """Classes of plain patterns, else -1. 0: alike in every known text and near in number. 1: alike in two texts
    but not in another or not in number, as works that continue each other. 2 + k: alike in text k at most."""
    similar = np.where(patterns[:, :texts] > 0, (patterns[:, :texts] - 1) / STEPS, np.nan)
    with np.errstate(invalid="ignore"):
        high, low = (similar >= 0.5).sum(1), (similar < 0.4).sum(1)
    best = np.where(np.isnan(similar), -1.0, similar).argmax(1)
    gap = patterns[:, texts]
    out = np.full(len(patterns), -1)
    out[(high >= 2) & (low == 0) & (gap <= 2)] = 0
    out[(high >= 2) & ((low > 0) | (gap >= 3))] = 1
    apart = (high <= 1) & (low > 0)
    out[apart] = 2 + best[apart]
    return out


def match_records(left: DataFrame, right: DataFrame, id_col: str, fields: tuple[TextField, ...], number: str, label: str) -> DataFrame:
    """(id1, id2, confidence): pairs of a record of ``left`` and one of ``right`` that were compared, with the probability of a match.

    Pairs are compared if their vectors of any field are close (:func:`close_pairs`). ``number`` is an
    integer attribute (a year) whose gap is compared, ``label`` a text of which initials are compared. The
    confidence comes from the mixture model over the Dice similarities of all fields, the gap, the
    label, and what only one record has in the first field; unknown attributes say nothing. Null, empty and blank attributes are unknown. Records that are
    encoded alike are compared once. A record without a word in any field has no pairs, rows
    with a null id are no records, repeated rows give their pairs once; other columns are ignored. Empty
    tables give no pairs.
    """
    links, members = match_classes(left, right, id_col, fields, number, label)
    # Classes of records encoded alike are written out as their members again.
    firsts = members.where("side = 1").select(F.col("sid").alias("s1"), F.col("id").alias("id1"))
    seconds = members.where("side = 2").select(F.col("sid").alias("s2"), F.col("id").alias("id2"))
    return links.join(firsts, "s1").join(seconds, "s2").select("id1", "id2", "confidence")


def match_classes(left: DataFrame, right: DataFrame, id_col: str, fields: tuple[TextField, ...], number: str, label: str) -> tuple[DataFrame, DataFrame]:
    """The links (s1, s2, confidence) between classes of records that are encoded alike, and the members (side, id, sid) of the classes.

    As :func:`match_records`, without copies made into pairs. Classes are told apart by two 64-bit hashes of all that is encoded.
    """
    vectors = [c for f in fields for c in f.columns()]
    attributes = ["number", "label", "ending", *vectors]
    with scope():
        records = materialize(encoded(left, right, id_col, fields, number, label))
        hashed = records.withColumns({"h1": F.xxhash64("side", *attributes), "h2": F.xxhash64(F.lit(1), "side", *attributes)})
        with outliving():
            distinct = hashed.groupBy("h1", "h2").agg(F.min("id").alias("sid"), *[F.first(c).alias(c) for c in ("side", *attributes)])
            distinct = materialize(distinct)
            members = hashed.select("side", "id", "h1", "h2").join(distinct.select("h1", "h2", "sid"), ["h1", "h2"])
            members = materialize(members.select("side", "id", "sid").distinct())
    with scope():
        found = materialize(reduce(DataFrame.unionByName, [close_pairs(distinct, f) for f in fields]).distinct())
        one = distinct.where("side = 1").select(F.col("sid").alias("s1"), *[F.col(c).alias(f"l_{c}") for c in attributes])
        two = distinct.where("side = 2").select(F.col("sid").alias("s2"), *[F.col(c).alias(f"r_{c}") for c in attributes])
        seen = outcomes(fields)
        names = [f"o{i}" for i in range(len(seen))]  # by number: the ending is the last
        with outliving():
            compared = materialize(found.join(one, "s1").join(two, "s2").select("s1", "s2", *seen))
        sizes = [STEPS + 2] * len(fields) + [5, 3, 10, 4]
        patterns = materialize(compared.groupBy(*names).count())
        model = fit_patterns(patterns, names, sizes, len(fields))
    return compared.select("s1", "s2", model.posterior(names).alias("confidence")), members
