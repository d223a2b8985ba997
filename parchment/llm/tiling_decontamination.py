"""Benchmark decontamination by greedy string tiling.

Words of a document and of a benchmark item that both hold a seed (a run of `least` words) are tiled: again
and again the longest unmarked common runs of words are found with running Karp-Rabin hashes, longest length
first, and marked in both, until none of `least` words is left. A document leaks an item if the tiles cover
enough of the item, in whatever order the passages stand.

Scale: the benchmark is the query set. It is read in blocks of bounded size; each block's seeds travel with
the tasks and every document is read once for each block, so nothing is shuffled and no block grows with the
corpus. A pair is tiled only if its seeds could cover enough of the item, which is exact.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Words of a seed and of the shortest tile; share of an item's words that tiles must cover.
LEAST, COVERAGE = 5, 0.5
#: Benchmark text held by a task at once.
BLOCK_BYTES = 4 << 20
PUNCTUATION = string.punctuation.encode()
MULT = np.uint64(0x9E3779B97F4A7C55)


def words_of(text: bytes | None) -> list[bytes]:
    """Case-folded words without the punctuation around them, so that shouting or a changed comma hides nothing."""
    return [x for w in (text or b"").decode("utf-8", "replace").casefold().encode().split() if (x := w.strip(PUNCTUATION))]


def runs(w: np.ndarray, k: int, prefix: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Karp-Rabin hashes of all runs of k word hashes, from running prefix hashes."""
    return prefix[k:] - prefix[: len(w) - k + 1] * powers[k]


def prefixes(w: np.ndarray) -> np.ndarray:
    out = np.zeros(len(w) + 1, np.uint64)
    h = 0
    for i, x in enumerate(w.tolist()):
        h = (h * int(MULT) + x) & 0xFFFFFFFFFFFFFFFF
        out[i + 1] = h
    return out


def tiles(doc: np.ndarray, item: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two arrays of word hashes: (place in doc, place in item, length), longest first, leftmost of equals."""
    n, m = len(doc), len(item)
    size = min(n, m)
    if size < least:
        return []
    powers = np.array([pow(int(MULT), k, 1 << 64) for k in range(size + 1)], np.uint64)
    pd, pi = prefixes(doc), prefixes(item)
    free_d, free_i = np.ones(n, bool), np.ones(m, bool)
    out = []

    def free_runs(free: np.ndarray, k: int) -> np.ndarray:
        s = np.concatenate([[0], np.cumsum(free)])
        return s[k:] - s[:-k] == k

    while True:
        # the longest common unmarked run: lengths with a common run are all lengths up to it
        low, high, found = least, size, None
        while low <= high:
            k = (low + high) // 2
            hd, hi = runs(doc, k, pd, powers), runs(item, k, pi, powers)
            at_d, at_i = np.flatnonzero(free_runs(free_d, k)), np.flatnonzero(free_runs(free_i, k))
            common = np.isin(hi[at_i], hd[at_d])
            if common.any():
                found, low = (k, at_d, at_i[common], hd, hi), k + 1
            else:
                high = k - 1
        if found is None:
            return sorted(out, key=lambda t: (-t[2], t[0]))
        k, at_d, at_i, hd, hi = found
        size = k
        for i in at_i.tolist():
            if free_i[i : i + k].all():
                for d in at_d[hd[at_d] == hi[i]].tolist():
                    if free_d[d : d + k].all():
                        out.append((d, i, k))
                        free_d[d : d + k] = free_i[i : i + k] = False
                        break


class Block:
    """Items of one block: their word hashes and the seeds that they hold."""

    def __init__(self, items: list[tuple[int, bytes | None]], least: int):
        cache = C.WordHash()
        self.least, self.ids, self.words = least, [], []
        for i, text in items:
            w = cache.of(words_of(text))
            if len(w):
                self.ids.append(i)
                self.words.append(w)
        #: an item with fewer words than a seed is one seed of its own length
        self.sizes = sorted({min(least, len(w)) for w in self.words})
        self.seeds = {}
        for k in self.sizes:
            rows = [(C.grams(w, k, seed=51), j) for j, w in enumerate(self.words) if min(least, len(w)) == k]
            h = np.concatenate([g for g, _ in rows])
            item = np.concatenate([np.full(len(g), j) for g, j in rows])
            place = np.concatenate([np.arange(len(g)) for g, _ in rows])
            order = np.argsort(h, kind="stable")
            self.seeds[k] = (h[order], item[order], place[order])

    def leaks(self, w: np.ndarray, coverage: float) -> Iterator[tuple[int, float, int, int]]:
        """(item id, coverage, tiles, longest tile) of the items that a document leaks."""
        for k, (keys, item, place) in self.seeds.items():
            g = np.unique(C.grams(w, k, seed=51))
            if not len(g):
                continue
            g = g[keys[np.minimum(np.searchsorted(keys, g), len(keys) - 1)] == g]
            if not len(g):
                continue
            hit = np.isin(keys, g)
            items, places = item[hit], place[hit]
            for j in np.unique(items).tolist():
                own = self.words[j]
                edge = np.zeros(len(own) + 1, np.int64)
                at = places[items == j]
                np.add.at(edge, at, 1)
                np.add.at(edge, at + k, -1)
                if (np.cumsum(edge)[:-1] > 0).sum() < coverage * len(own):
                    continue
                t = tiles(w, own, k)
                share = sum(x[2] for x in t) / len(own)
                if share >= coverage:
                    yield self.ids[j], share, len(t), max(x[2] for x in t)


def _leaks(block, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = C.WordHash()
        for batch in batches:
            got = [(i, *x) for i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for x in block.value.leaks(cache.of(words_of(text)), coverage)]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*got, strict=True)], ["doc_id", "item_id", "coverage", "n_tiles", "longest_tile"])

    return run


def _clean(block, coverage: float, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = C.WordHash()
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array([not any(True for _ in block.value.leaks(cache.of(words_of(t)), coverage)) for t in texts], pa.bool_()))

    return run


def blocks(benchmark: DataFrame, least: int = LEAST, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The benchmark's items, a bounded number of bytes at a time; only one block is on the driver at once."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("binary"))
    items, size = [], 0
    for i, text in rows.toLocalIterator():
        items.append((i, bytes(text) if text is not None else None))
        size += len(text or b"")
        if size >= block_bytes:
            yield Block(items, least)
            items, size = [], 0
    if items:
        yield Block(items, least)


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest_tile) of every row of docs and item it leaks.

    Null or wordless texts leak nothing and null or wordless items are leaked by none; null ids are kept as
    null; repeated rows and items are each reported; without leaks, documents or items the result is empty.
    """
    spark = docs.sparkSession
    C.ship(spark)
    kind = "doc_id long, item_id long, coverage double, n_tiles long, longest_tile long"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    out = None
    for b in blocks(benchmark, least):
        found = rows.mapInArrow(C.lean(_leaks(spark.sparkContext.broadcast(b), coverage)), kind)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], kind)


def clean(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE, text_col: str = "text") -> DataFrame:
    """The rows of docs that leak no item, each judged by its own text: ids may be null or repeat. All columns are kept."""
    spark = docs.sparkSession
    C.ship(spark)
    at = docs.columns.index(text_col)
    for b in blocks(benchmark, least):
        docs = docs.mapInArrow(C.lean(_clean(spark.sparkContext.broadcast(b), coverage, at)), docs.schema)
    return docs
