"""Frequency of every distinct term by burst tries.

A burst trie keeps terms in small containers; a container that grows beyond its capacity bursts
into one container per next character, so the prefixes adapt to the terms. Rows are brought together
by record, so that every worker can count occurrences and records of its terms in such tries before
anything is shuffled by term. Each container of a worker becomes one row. The rows below every short
prefix are summed in one pass: prefixes that are too heavy for one task part into longer ones, and
what is too heavy at the longest parts by the hash of its terms, so no route outgrows a task. Matching
subtrees meet by route and are merged.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.sources.scratch import materialize

#: Terms in a container before it bursts.
CAPACITY = 256
#: Terms in a worker's trie before its containers are handed on.
TRIE_TERMS = 400_000
#: Terms that are counted at once before they go into a trie.
SLICE = 300_000
#: Container entries of all workers that meet in one route.
ROUTE_ENTRIES = 100_000
#: The longest prefix that is a route; what is heavier parts by hash.
DEEPEST = 8


class BurstTrie:
    """Counts of occurrences and of records by term."""

    __slots__ = ("capacity", "root", "terms")

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.root: dict = {}  # of a node: next character -> node or container; "" -> the term that ends here
        self.terms = 0

    def add(self, term: str, occurrences: int, records: int) -> None:
        node, depth = self.root, 0
        while True:
            if depth == len(term):
                held = node.get("")
                if held is None:
                    node[""] = [occurrences, records]
                    self.terms += 1
                else:
                    held[0] += occurrences
                    held[1] += records
                return
            child = node.get(term[depth])
            if child is None:
                child = node[term[depth]] = _Container()
            depth += 1
            if child.__class__ is dict:
                node = child
                continue
            tail = term[depth:]
            held = child.get(tail)
            if held is not None:
                held[0] += occurrences
                held[1] += records
                return
            child[tail] = [occurrences, records]
            self.terms += 1
            if len(child) > self.capacity:
                node[term[depth - 1]] = _burst(child)
            return

    def containers(self) -> Iterator[tuple[str, dict]]:
        """(prefix, terms without it) of every container, and of every term that ends at a node."""
        stack = [("", self.root)]
        while stack:
            prefix, node = stack.pop()
            for key, child in node.items():
                if key == "":
                    yield prefix, {"": child}
                elif child.__class__ is dict:
                    stack.append((prefix + key, child))
                else:
                    yield prefix + key, child


class _Container(dict):
    """Tails of terms with their counts."""

    __slots__ = ()


def _burst(container: _Container) -> dict:
    node: dict = {}
    for tail, held in container.items():
        if not tail:
            node[""] = held
        else:
            node.setdefault(tail[0], _Container())[tail[1:]] = held
    return node


ENTRIES = [("tails", pa.list_(pa.string())), ("occurrences", pa.list_(pa.int64())), ("records", pa.list_(pa.int64()))]
SQL_ENTRIES = "tails array<string>, occurrences array<long>, records array<long>"
CONTAINERS = pa.schema([("prefix", pa.string()), *ENTRIES])
ROUTED = pa.schema([("route", pa.string()), *CONTAINERS])


def _batches(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for start in range(0, len(rows), 512):
        columns = zip(*rows[start : start + 512], strict=True)
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _containers(trie: BurstTrie) -> Iterator[pa.RecordBatch]:
    rows = [(prefix, list(held), [x[0] for x in held.values()], [x[1] for x in held.values()]) for prefix, held in trie.containers()]
    yield from _batches(rows, CONTAINERS)


def _distinct_counts(rows: pa.Table) -> tuple[list, np.ndarray, np.ndarray, int]:
    """Of (rec, terms, n) rows the distinct terms with occurrences and records, and the number of records. ``n`` is how often each row counts."""
    lists = rows["terms"].combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    length = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    length = np.nan_to_num(length.astype(float)).astype(np.int64)
    flat = lists.flatten().dictionary_encode()
    if not len(flat):
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    number = rows["rec"].combine_chunks().dictionary_encode()
    number = number.combine_chunks() if isinstance(number, pa.ChunkedArray) else number
    record = np.repeat(number.indices.to_numpy().astype(np.int64), length)
    code = flat.indices.to_numpy().astype(np.int64)
    terms = len(flat.dictionary)
    occurrences = np.bincount(code, weights=np.repeat(rows["n"].to_numpy(), length), minlength=terms).astype(np.int64)
    records = np.bincount(np.unique(record * terms + code) % terms, minlength=terms)
    return flat.dictionary.to_pylist(), occurrences, records, len(np.unique(record))


def _count(capacity: int):
    """Rows (rec, terms, n) come record by record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, held, size, seen = BurstTrie(capacity), [], 0, 0

        def add(rows: pa.Table) -> int:
            terms, occurrences, records, n = _distinct_counts(rows)
            for term, o, r in zip(terms, occurrences.tolist(), records.tolist(), strict=True):
                trie.add(term, o, r)
            return n

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += int(pc.sum(pc.list_value_length(batch.column("terms"))).as_py() or 0)
            if size < SLICE:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            rec = rows["rec"].to_numpy()
            last = int(np.flatnonzero(rec != rec[-1]).max(initial=-1)) + 1  # the last record may go on
            seen += add(rows.slice(0, last)) if last else 0
            held = rows.slice(last).to_batches()
            size = int(pc.sum(pc.list_value_length(rows["terms"].slice(last))).as_py() or 0)
            if trie.terms >= TRIE_TERMS:
                yield from _containers(trie)
                trie = BurstTrie(capacity)
        if held:
            seen += add(pa.Table.from_batches(held))
        yield from _containers(trie)
        # How many records were counted here: a row without a prefix.
        yield from _batches([(None, [], [], [seen])], CONTAINERS)

    return run


def _count_new(capacity: int):
    """Rows (term, n), each of another record or term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = BurstTrie(capacity)
        for batch in batches:
            for term, n in zip(batch.column("term").to_pylist(), batch.column("n").to_pylist(), strict=True):
                trie.add(term, n, 1)
            if trie.terms >= TRIE_TERMS:
                yield from _containers(trie)
                trie = BurstTrie(capacity)
        yield from _containers(trie)

    return run


def _route(term: str, heavy: dict[str, int]) -> str:
    """The shortest prefix of the term that is not too heavy; at the longest, with a part by hash."""
    depth = 0
    while depth < len(term) and depth < DEEPEST and term[:depth] in heavy:
        depth += 1
    prefix = term[:depth]
    parts = heavy.get(prefix, 0) if depth == DEEPEST else 0
    return f"{prefix}\x00{zlib.crc32(term.encode()) % parts}" if parts else prefix


def _place(heavy: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, parted = [], {}
            for row in batch.to_pylist():
                prefix = row["prefix"]
                route = _route(prefix, heavy)
                if route not in heavy and "\x00" not in route:
                    whole.append((route, prefix, row["tails"], row["occurrences"], row["records"]))
                    continue
                # The container stands above the routes: its terms part here.
                for tail, n, records in zip(row["tails"], row["occurrences"], row["records"], strict=True):
                    entry = parted.setdefault(_route(prefix + tail, heavy), ([], [], []))
                    for at, x in zip(entry, (prefix + tail, n, records), strict=True):
                        at.append(x)
            yield from _batches(whole + [(route, "", *entry) for route, entry in parted.items()], ROUTED)

    return run


MERGED = pa.schema([("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])


def _merge(capacity: int):
    """Rows come route by route: a subtree is complete when its route ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        route, trie = None, BurstTrie(capacity)

        def merged():
            terms = [(prefix + tail, *counts) for prefix, held in trie.containers() for tail, counts in held.items()]
            for start in range(0, len(terms), 50_000):
                yield pa.record_batch([pa.array([t[i] for t in terms[start : start + 50_000]], f.type) for i, f in enumerate(MERGED)], schema=MERGED)

        for batch in batches:
            for row in batch.to_pylist():
                if row["route"] != route:
                    yield from merged()
                    route, trie = row["route"], BurstTrie(capacity)
                prefix = row["prefix"]
                for tail, n, records in zip(row["tails"], row["occurrences"], row["records"], strict=True):
                    trie.add(prefix + tail, n, records)
        yield from merged()

    return run


def heavy_prefixes(containers: DataFrame, entries: int = ROUTE_ENTRIES) -> dict[str, int]:
    """Prefixes of up to :data:`DEEPEST` characters with more than ``entries`` container entries below, and in how many parts they would fit.

    At each length there are fewer than all entries / ``entries`` such, so as many times :data:`DEEPEST` come to the driver.
    """
    weights = containers.select("prefix", F.size("tails").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(DEEPEST))).alias("depth"))
    own = weights.where(F.col("depth") <= F.length("prefix")).select(F.expr("substring(prefix, 1, depth)").alias("prefix"), "n")
    found = lambda rows: {r["prefix"]: math.ceil(r["n"] / entries) for r in rows.groupBy("prefix").agg(F.sum("n").alias("n")).where(F.col("n") > entries).collect()}
    heavy = found(own)
    if not heavy:
        return heavy
    # The terms of a container right at a heavy prefix part by their next characters.
    at = F.broadcast(containers.sparkSession.createDataFrame([(p,) for p in heavy], "prefix string"))
    short = containers.where(F.length("prefix") < DEEPEST).join(at, "prefix").select("prefix", F.explode("tails").alias("tail"))
    term = short.select(F.concat("prefix", "tail").alias("term"), F.explode(F.sequence(F.length("prefix") + 1, F.lit(DEEPEST))).alias("depth"))
    below = term.where(F.col("depth") <= F.length("term")).select(F.expr("substring(term, 1, depth)").alias("prefix"), F.lit(1).alias("n"))
    return found(own.unionByName(below))


def routed(containers: DataFrame, entries: int = ROUTE_ENTRIES) -> DataFrame:
    """(route, prefix, tails, occurrences, records): every container, or part of one, with the route its terms meet on."""
    return containers.mapInArrow(_place(heavy_prefixes(containers, entries)), f"route string, prefix string, {SQL_ENTRIES}")


def worker_containers(bags: DataFrame, record: str, terms: str, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """(prefix, tails, occurrences, records) of the tries of all workers, and the number of records with any term.

    Bags are shuffled whole, by record. A record with more than a thousandth of all rows would fill a
    task: its terms are made distinct one by one instead. There are fewer than a thousand such, they are broadcast.
    """
    clean = F.transform(F.col(f"`{terms}`"), lambda x: F.regexp_replace(F.lower(x), r"^\s+|\s+$", ""))
    bags = bags.select(F.col(f"`{record}`").alias("rec"), F.filter(clean, lambda x: x != "").alias("terms"))
    bags = bags.where(F.col("rec").isNotNull() & (F.size("terms") > 0))
    sizes = bags.groupBy("rec").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("all"))
    many = sizes.crossJoin(F.broadcast(total)).where((F.col("n") > 1000) & (F.col("n") * 1000 > F.col("all"))).select("rec")
    many = materialize(many)
    none = not many.count()
    light = bags if none else bags.join(F.broadcast(many), "rec", "left_anti")
    schema = f"prefix string, {SQL_ENTRIES}"
    placed = light.withColumn("n", F.lit(1)).repartition("rec").sortWithinPartitions("rec")
    counted = placed.mapInArrow(_count(capacity), schema)
    heavy_records = 0
    if not none:
        rows = bags.join(F.broadcast(many), "rec").select("rec", F.explode("terms").alias("term"))
        pairs = materialize(rows.groupBy("term", "rec").agg(F.count("*").alias("n")))
        heavy_records = pairs.select("rec").distinct().count()
        counted = counted.unionByName(pairs.select("term", "n").mapInArrow(_count_new(capacity), schema))
    counted = materialize(counted)
    held = counted.where("prefix is null").agg(F.sum(F.get("records", F.lit(0)))).first()[0] or 0
    return counted.where("prefix is not null"), held + heavy_records


def term_frequencies(bags: DataFrame, record: str, terms: str, capacity: int = CAPACITY, entries: int = ROUTE_ENTRIES) -> DataFrame:
    """(term, occurrences, records): how often every distinct term occurs, and in how many records.

    ``terms`` is an array column. Terms are read in lower case without outer white space; null and
    empty ones do not count, null and empty arrays neither. A record is a value of ``record`` over
    all its rows, rows with a null record form no record. Every stored row counts for ``occurrences``, resent
    ones too; ``records`` counts each record once. Other columns are ignored. An empty table gives no rows.
    """
    return _merged(worker_containers(bags, record, terms, capacity)[0], capacity, entries)


def _merged(containers: DataFrame, capacity: int, entries: int) -> DataFrame:
    placed = routed(containers, entries).repartition("route").sortWithinPartitions("route")
    return placed.mapInArrow(_merge(capacity), "term string, occurrences long, records long")


def marked_frequencies(bags: DataFrame, record: str, terms: str, rare: int = 2, common: float = 0.2, entries: int = ROUTE_ENTRIES) -> DataFrame:
    """:func:`term_frequencies` with ``mark``: ``rare`` in at most ``rare`` records, ``common`` in more than the
    share ``common`` of the records that have any term, else null.
    """
    containers, total = worker_containers(bags, record, terms)
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > total * common, "common")
    return _merged(containers, CAPACITY, entries).select("term", "occurrences", "records", mark.alias("mark"))
