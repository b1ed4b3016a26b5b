"""BM25 top-k join.

The index is cut into blocks of records and kept as lists of postings per token and block. It lies in the
folder all executors share; each task holds whole search records and reads the blocks one after the other,
so neither postings nor partial scores are shuffled, and a record's k best are final within its task.

Of a record and block the shortest lists are added up first. The whole scores of the k best so far, or
of the blocks before, are a lower bound of what the k best reach; once all longer lists together cannot
reach it, no other record can be among the k best, and the longer lists are looked up for what is left only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pairloom.functions.tokenizers import Tokenizer
from pairloom.operators.topk import check_k
from pairloom.sources.scratch import is_dry, materialize, open_folder

K1, B = 1.2, 0.75
#: Scores are compared after rounding to six places; bounds keep a distance above that.
MARGIN = 1e-5
#: Index records in a block, and about how many tokens of them.
BLOCK_DOCS = 262_144
BLOCK_TOKENS = 4_000_000
#: Search records that are scored in one pass over the blocks.
SALT_QUERIES = 20_000
#: Tokens of search records that are scored in one pass over the blocks.
SLICE = 2_000_000
#: Pairs whose index records are looked up together.
LOOKUP = 500_000

LISTS = "block int, tok string, n int, docs array<int>, shares array<double>, ids array<long>"


@dataclass(frozen=True)
class BM25Index:
    """``lists`` (block, tok, n, docs, shares, ids), written once, and the number of records with a text.

    ``docs`` are a token's ``n`` records, numbered within the block in order of their ids, and ``shares`` what they
    have of its weight. The row of a block without ``tok`` has the ids of its records.
    """

    lists: DataFrame
    docs: int
    blocks: int


def _block_lists(average: float):
    """Rows (block, id1, toks) come block by block and become the block's lists."""

    def lists(block: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = rows["id1"].to_numpy()
        order = np.argsort(ids, kind="stable")
        rows = rows.take(pa.array(order)).combine_chunks()
        ids = ids[order]
        toks = pa.concat_arrays(rows["toks"].chunks)
        length = pc.list_value_length(toks).to_numpy(zero_copy_only=False).astype(np.int64)
        held = toks.flatten().dictionary_encode()
        words = held.dictionary
        code = held.indices.to_numpy().astype(np.int64)
        n = len(ids)
        # Token by token, then record by record, with the number of times.
        both, times = np.unique(code * n + np.repeat(np.arange(n), length), return_counts=True)
        doc = both % n
        share = times / (times + K1 * (1.0 - B + B * length[doc] / average))
        start = np.searchsorted(both // n, np.arange(len(words) + 1)).astype(np.int32)
        yield batch(block, pa.array([None], pa.string()), np.zeros(2, np.int32), doc[:0], share[:0], np.array([0, n], np.int32), ids)
        step = 4096
        for at in range(0, len(words), step):
            ends = start[at : at + step + 1]
            part = slice(ends[0], ends[-1])
            yield batch(block, words.slice(at, step), ends - ends[0], doc[part], share[part], np.zeros(len(ends), np.int32), ids[:0])

    def batch(block, words, ends, doc, share, id_ends, ids) -> pa.RecordBatch:
        of = lambda at, values: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values))
        arrays = [pa.array(np.full(len(words), block, np.int32)), words, pa.array(np.diff(ends).astype(np.int32)), of(ends, doc.astype(np.int32)), of(ends, share), of(id_ends, ids)]
        return pa.record_batch(arrays, names=["block", "tok", "n", "docs", "shares", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for rows in batches:
            block = rows.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and block[a] != now:
                    yield from lists(now, pa.Table.from_batches(held))
                    held = []
                now = int(block[a])
                held.append(rows.slice(a, b - a))
        if held:
            yield from lists(now, pa.Table.from_batches(held))

    return run


def bm25_index(index: DataFrame, index_col: str, tokenizer: Tokenizer, block_docs: int = BLOCK_DOCS) -> BM25Index:
    """Index the records (id, text). Statistics are global over those with a text."""
    texts = index.select(F.col("id").cast("long").alias("id1"), F.col(index_col).alias("_text")).where("_text is not null")
    if is_dry():
        return BM25Index(texts.sparkSession.createDataFrame([], LISTS), 0, 0)
    stats = texts.select(F.size(tokenizer.tokens(F.col("_text"))).alias("dl")).agg(F.count("*"), F.sum("dl"), F.avg("dl")).first()
    docs, total, average = stats[0], stats[1] or 0, stats[2] or 1.0
    blocks = max(1, math.ceil(docs / block_docs), math.ceil(total / BLOCK_TOKENS))
    # The texts are shuffled, not their tokens.
    placed = texts.withColumn("block", F.pmod(F.xxhash64("id1"), F.lit(blocks)).cast("int")).repartition(blocks, "block").sortWithinPartitions("block")
    rows = placed.select("block", "id1", tokenizer.tokens(F.col("_text")).alias("toks"))
    return BM25Index(materialize(rows.mapInArrow(_block_lists(average or 1.0), LISTS), by="block"), docs, blocks)


def _micros(score: np.ndarray) -> np.ndarray:
    """Scores rounded half up to six places as Spark's round() does, in millionths."""
    scaled = score * 1e6
    low = np.floor(scaled)
    out = np.floor(scaled + 0.5).astype(np.int64)
    for i in np.flatnonzero(np.abs(scaled - low - 0.5) < 1e-4).tolist():  # the decimal digits tell
        out[i] = int(Decimal(repr(float(score[i]))).scaleb(6).quantize(Decimal(1), ROUND_HALF_UP))
    return out


def _best(micros: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -micros))[:k]
    return micros[order], ids[order]


class _Block:
    """The lists of one block that some search record asks for."""

    def __init__(self, folder: ds.Dataset, wanted: pa.Array, size: int):
        """``at`` has the place of each wanted token, or -1; ``most`` the largest share in each list."""
        # The lists are read piece by piece and only those asked for are held.
        self.at = np.full(size, -1)
        self.ids = np.zeros(0, np.int64)
        docs, shares, ends, most = [], [], [np.zeros(1, np.int64)], []
        lists = 0
        for rows in folder.to_batches(columns=["tok", "docs", "shares", "ids"], batch_size=8192):
            whole = rows.filter(pc.is_null(rows.column("tok")))
            if whole.num_rows:
                self.ids = whole.column("ids").flatten().to_numpy()
            code = pc.index_in(rows.column("tok"), wanted)
            known = pc.and_(pc.is_valid(code), pc.is_valid(rows.column("tok")))
            code = code.filter(known).to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(code):
                continue
            kept = rows.filter(known)
            length = pc.list_value_length(kept.column("docs")).to_numpy(zero_copy_only=False).astype(np.int64)
            docs.append(kept.column("docs").flatten().to_numpy())
            shares.append(kept.column("shares").flatten().to_numpy())
            most.append(np.maximum.reduceat(shares[-1], np.cumsum(length) - length))
            ends.append(length)
            self.at[code] = lists + np.arange(len(code))
            lists += len(code)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.docs, self.shares, self.most = join(docs, np.int32), join(shares, float), join(most, float)
        self.start = np.cumsum(np.concatenate(ends))
        self.total, self.laid = np.zeros(len(self.ids)), np.zeros(len(self.ids))
        self.mark = np.zeros(len(self.ids), np.int64)

    def _kth(self, docs: np.ndarray, sums: np.ndarray, k: int, lists: int) -> float:
        """A lower bound of the k-th best sum of the distinct ``docs``, each of which is met at most once in each of so many lists."""
        most = min(len(sums), k * lists)
        if most < k:
            return -np.inf
        top = self._distinct(docs[np.argpartition(sums, len(sums) - most)[len(sums) - most :]])
        if len(top) < k:
            return -np.inf
        return float(np.partition(self.total[top], len(top) - k)[len(top) - k])

    def _distinct(self, docs: np.ndarray) -> np.ndarray:
        place = np.arange(len(docs))
        self.mark[docs] = place
        return docs[self.mark[docs] == place]

    def _part(self, docs: np.ndarray, begin: int, end: int, weight: float) -> np.ndarray:
        """What one list adds to each of ``docs``."""
        listed, shares = self.docs[begin:end], self.shares[begin:end]
        if len(docs) * 20 > len(listed):  # many: the list is laid out
            self.laid[listed] = shares
            out = weight * self.laid[docs]
            self.laid[listed] = 0.0
            return out
        place = np.searchsorted(listed, docs)
        place[place == len(listed)] = 0
        return np.where(listed[place] == docs, weight * shares[place], 0.0)

    def _whole(self, docs: np.ndarray, sums: np.ndarray, k: int, done: int, begin: list, end: list, weight: list) -> float:
        """The k-th best of the whole sums of the records that are best so far: a lower bound near the true one."""
        most = min(len(sums), k * done)
        best = self._distinct(docs[np.argpartition(sums, len(sums) - most)[len(sums) - most :]])
        if len(best) < k:
            return -np.inf
        so_far = self.total[best]
        best = np.sort(best[np.argpartition(so_far, len(best) - k)[len(best) - k :]])
        whole = self.total[best]
        for i in range(done, len(begin)):
            whole += self._part(best, begin[i], end[i], weight[i])
        return float(whole.min())

    def search(self, asked: np.ndarray, idf: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray] | None:
        """Sums in millionths and ids of the records that may be among the ``k`` best, at most ``k``; ``least`` is a lower bound of their sums."""
        at = self.at[asked]
        asked, at = asked[at >= 0], at[at >= 0]
        if not len(at):
            return None
        begin, end = self.start[at], self.start[at + 1]
        order = np.argsort(end - begin, kind="stable")
        begin, end, weight = begin[order].tolist(), end[order].tolist(), idf[asked[order]].tolist()
        bound = idf[asked[order]] * self.most[at[order]]
        rest = (np.cumsum(bound[::-1])[::-1]).tolist()  # of this list and all longer ones
        if rest[0] < least - MARGIN:
            return None
        total, met, seen, done, n = self.total, [], 0, 0, len(begin)
        checked = 0
        while done < n:
            # The best so far are summed up whole each time that four times as many records are met.
            if done and end[done] - begin[done] > 64 and seen >= k and seen > max(checked * 4, len(self.ids) // 50):
                checked = seen
                met = [np.concatenate(met)]
                least = max(least, self._whole(met[0], total[met[0]], k, done, begin, end, weight))
            if rest[done] < least - MARGIN:
                break
            docs = self.docs[begin[done] : end[done]]
            total[docs] += weight[done] * self.shares[begin[done] : end[done]]
            met.append(docs)
            seen += len(docs)
            done += 1
        late = rest[done] if done < n else 0.0
        docs = np.concatenate(met) if met else np.zeros(0, np.int32)
        sums = total[docs]
        least = max(least, self._kth(docs, sums, k, done))
        near = self._distinct(docs[sums >= least - late - MARGIN])
        sums = total[near]
        total[docs] = 0.0
        for i in range(done, n):
            keep = sums >= least - rest[i] - MARGIN
            near, sums = near[keep], sums[keep]
            sums += self._part(near, begin[i], end[i], weight[i])
        if len(sums) > k:
            keep = sums >= np.partition(sums, len(sums) - k)[len(sums) - k] - MARGIN
            near, sums = near[keep], sums[keep]
        return _best(_micros(sums), self.ids[near], k)


def _best_of(toks: pa.ChunkedArray, path: str, blocks: int, docs: int, k: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The sums in millionths and the ids of the ``k`` best of each search record that has any, by its place."""
    start = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(toks), 0).to_numpy())])
    words = pa.concat_arrays(toks.chunks).flatten().dictionary_encode()
    code, wanted = words.indices.to_numpy(), words.dictionary
    folders = [open_folder(f"{path}/block={i}") for i in range(blocks)]
    df = np.zeros(len(wanted))
    for folder in folders:
        for part in folder.to_batches(columns=["tok", "n"]) if folder is not None and len(wanted) else ():
            at = pc.index_in(part.column("tok"), wanted)
            known = pc.and_(pc.is_valid(at), pc.is_valid(part.column("tok")))
            df[at.filter(known).to_numpy(zero_copy_only=False)] += part.column("n").filter(known).to_numpy(zero_copy_only=False)
    idf = np.log(1.0 + (docs - df + 0.5) / (df + 0.5))
    best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for folder in folders if len(wanted) else ():
        if folder is None:
            continue
        block = _Block(folder, wanted, len(wanted))
        for i in range(len(toks)):
            known = best.get(i)
            least = known[0][-1] / 1e6 if known is not None and len(known[0]) == k else -np.inf
            found = block.search(code[start[i] : start[i + 1]], idf, k, least)
            if found is None:
                continue
            if known is not None:
                found = _best(np.concatenate([known[0], found[0]]), np.concatenate([known[1], found[1]]), k)
            best[i] = found
    return {i: best[i] for i in sorted(best) if len(best[i][0])}


def _in_passes(answered, columns: list[str], most_queries: int, most_tokens: int):
    """Search records with token ``columns`` are answered pass by pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        queries = tokens = 0
        for rows in batches:
            if not rows.num_rows:
                continue
            held.append(rows)
            queries += rows.num_rows
            tokens += sum(pc.sum(pc.list_value_length(rows.column(c))).as_py() or 0 for c in columns)
            if queries >= most_queries or tokens >= most_tokens:
                yield from answered(pa.Table.from_batches(held))
                held, queries, tokens = [], 0, 0
        if held:
            yield from answered(pa.Table.from_batches(held))

    return run


def _search(path: str, blocks: int, docs: int, k: int, most_queries: int, most_tokens: int):
    """Rows (id2, toks) become the k best (id1, id2, score, rank) of each."""

    def answered(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        id2 = rows["id2"].to_numpy()
        best = _best_of(rows["toks"], path, blocks, docs, k)
        held_by = list(best)
        for a in range(0, len(held_by), 1000):
            part = held_by[a : a + 1000]
            sizes = [len(best[i][0]) for i in part]
            score = np.concatenate([best[i][0] for i in part]) / 1e6
            rank = np.concatenate([np.arange(1, n + 1) for n in sizes]).astype(np.int32)
            ids = np.concatenate([best[i][1] for i in part])
            yield pa.record_batch([pa.array(ids), pa.array(np.repeat(id2[part], sizes)), pa.array(score), pa.array(rank)], names=["id1", "id2", "score", "rank"])

    return _in_passes(answered, ["toks"], most_queries, most_tokens)


def _looked_up(path: str, ids: np.ndarray) -> pa.Table:
    """The rows (id1, …) of a Parquet folder with the distinct, ascending ``ids``, in their order."""
    parts = []
    for rows in open_folder(path).to_batches(batch_size=8192):
        id1 = rows.column("id1").to_numpy()
        parts.append(rows.filter(pa.array(ids[np.minimum(np.searchsorted(ids, id1), len(ids) - 1)] == id1)))
    held = pa.Table.from_batches(parts)
    _, first = np.unique(held["id1"].to_numpy(), return_index=True)
    return held.take(pa.array(first)).combine_chunks()


def _search_all(asked: list[tuple[str, int, int, int]], features: str, left: list[str], right: list[str], schema: pa.Schema):
    """Rows (id2, toks0, …, ``right``) become the pairs that any search finds, with their ranks and the columns of both records."""

    def answered(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        id2 = rows["id2"].to_numpy()
        best = [_best_of(rows[f"toks{j}"], *how) for j, how in enumerate(asked)]
        sizes = np.zeros(len(id2), np.int64)
        for found in best:
            sizes[list(found)] += [len(ids) for _, ids in found.values()]
        cuts = np.searchsorted(np.cumsum(sizes), np.arange(0, sizes.sum() + LOOKUP, LOOKUP), "right")
        for a, b in zip(cuts, [*cuts[1:], len(id2)], strict=True):
            yield from pairs(rows, id2, best, range(a, b))

    def pairs(rows: pa.Table, id2: np.ndarray, best: list, part: range) -> Iterator[pa.RecordBatch]:
        of = [[(i, found[i][1]) for i in part if i in found] for found in best]
        ids = np.concatenate([x for held in of for _, x in held] or [np.zeros(0, np.int64)])
        if not len(ids):
            return
        at = np.concatenate([np.full(len(x), i) for held in of for i, x in held])
        by = np.concatenate([np.full(len(x), j) for j, held in enumerate(of) for _, x in held])
        rank = np.concatenate([np.arange(1, len(x) + 1) for held in of for _, x in held])
        order = np.lexsort((ids, at))
        ids, at, by, rank = ids[order], at[order], by[order], rank[order]
        new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (at[1:] != at[:-1])])
        ranks = np.zeros((len(asked), int(new.sum())), np.int32)
        ranks[by, np.cumsum(new) - 1] = rank
        ids, at = ids[new], at[new]
        distinct = np.unique(ids)
        known = _looked_up(features, distinct) if left else None
        for i in range(0, len(ids), 10_000):
            one, two = ids[i : i + 10_000], at[i : i + 10_000]
            arrays = [pa.array(one), pa.array(id2[two]), *[pa.array(r[i : i + 10_000]) for r in ranks]]
            arrays += [known[c].take(pa.array(np.searchsorted(distinct, one))) for c in left] + [rows[c].take(pa.array(two)) for c in right]
            yield pa.Table.from_arrays([x.cast(f.type) for x, f in zip(arrays, schema, strict=True)], schema=schema).combine_chunks().to_batches()[0]

    return _in_passes(answered, [f"toks{j}" for j in range(len(asked))], SALT_QUERIES, SLICE)


def _tasks(search: DataFrame) -> int:
    """As many tasks as the session shuffles with, however few files the texts lie in."""
    return max(int(search.sparkSession.conf.get("spark.sql.shuffle.partitions")), search.sparkSession.sparkContext.defaultParallelism)


def _folder(index: BM25Index) -> str:
    return "" if is_dry() or not index.docs else index.lists.inputFiles()[0].rsplit("/block=", 1)[0]


def bm25_pairs(asks: list[tuple[BM25Index, str, Tokenizer, int]], index: DataFrame, search: DataFrame, left: list[Column], right: list[Column]) -> DataFrame:
    """(id1, id2, _p0, …, ``left``, ``right``): the pairs that are among the k best of any of the ``asks`` (index, search column, tokenizer, k).

    ``_p0``, … are the ranks in each, 0 if not among its best. ``left`` are named expressions over the index records, ``right`` over
    the search records. All searches of a record and the lookup of its partners run in one task: neither pairs nor what they need
    are shuffled. Nothing is run but the expressions of the index records, which are written once.
    """
    known = reduce(Column.__or__, [F.col(column).isNotNull() for _, column, _, _ in asks])
    placed = search.where(known).repartition(_tasks(search), "id")
    toks = [tokenizer.token_set(F.col(column)).alias(f"toks{j}") for j, (_, column, tokenizer, _) in enumerate(asks)]
    rows = placed.select(F.col("id").alias("id2"), *toks, *right)
    held = index.select(F.col("id").alias("id1"), *left)
    names = [c for c in held.columns if c != "id1"]
    carried = rows.columns[1 + len(asks) :]
    ranks = [f"_p{j}" for j in range(len(asks))]
    kinds = [T.StructField("id1", T.LongType()), T.StructField("id2", T.LongType()), *[T.StructField(r, T.IntegerType()) for r in ranks], *[held.schema[c] for c in names], *[rows.schema[c] for c in carried]]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in kinds])
    path = materialize(held).inputFiles() if names and not is_dry() else []
    how = [(_folder(x), x.blocks if _folder(x) else 0, x.docs, k) for x, _, _, k in asks]
    return rows.mapInArrow(_search_all(how, path[0].rsplit("/", 1)[0] if path else "", names, carried, to_arrow_schema(schema)), schema)


def bm25_top_k(index: DataFrame | BM25Index, search: DataFrame, index_col: str, search_col: str, tokenizer: Tokenizer, k: int, salt_queries: int = SALT_QUERIES) -> DataFrame:
    """(id1, id2, score, rank): for each search record (id, text) the ``k`` best index records that share a token.

    Statistics are global over the index records with a text. Each distinct query token counts once.
    Scores are rounded to six places before ranking; equal ones go to the smaller id1. The result is
    exact. The index and the result are computed when this is called.
    """
    check_k(k)
    known = index if isinstance(index, BM25Index) else bm25_index(index, index_col, tokenizer)
    texts = search.select(F.col("id").cast("long").alias("id2"), F.col(search_col).alias("_text")).where("_text is not null")
    asked = texts.repartition(_tasks(search), "id2").select("id2", tokenizer.token_set(F.col("_text")).alias("toks"))
    path = _folder(known)
    found = asked.mapInArrow(_search(path, known.blocks if path else 0, known.docs, k, salt_queries, SLICE), "id1 long, id2 long, score double, rank int")
    return materialize(found)
