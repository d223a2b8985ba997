"""Substring deduplication by prefix-partitioned suffix trees over words.

A window is `window` consecutive words. Its seed is its 8-word run with the least hash (the first of equals), so
equal windows have equal seeds in equal places. Suffixes are filed under the seed with which they begin, their
prefix; neighbouring windows share a seed, so a document sends one strand of text for all windows of a seed. A
prefix that occurs once holds no repeat and is dropped before any text is moved. A prefix under which more than
`MOST` strands lie is lengthened, to the right or to the left but within the window, to 14 words; one that is
still too common is lengthened to the whole window, which is then a node of its own: it needs no subtree, only its
first leaf, a partial minimum. Equal strands are counted as one before they are cut into windows.

A group of at most `MOST` strands fits in memory. Its suffixes are sorted word by word; their common prefix
lengths give the internal nodes of the group's suffix tree at each depth, and a second tree over the words before
the seed, read backwards, tells which leaves of a node agree further to the left. Leaves that meet in a node of
each tree whose depths add up to a window are occurrences of one repeat. All but the first in order of
(doc_id, position) go, and windows that overlap join into the maximal repeats that are cut out of a document.

Scale: of exact copies of a text only the first is cut into strands (later ones go as a whole). Groups are dealt by
their prefix and bounded; words are compared themselves in the trees, windows as nodes by 128-bit hashes of their
bytes. Joins with counts read written tables, so their common keys can be split.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW, SEED = 20, 8
#: Most strands under one prefix that are put into one subtree, and strands worked on at a time.
MOST, CHUNK = 2048, 32_768
FIRST = -(2**63)


def seeds(w: np.ndarray, window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the seed-word runs, and for each window the place of its least one (the first of equals)."""
    g = C.grams(w, min(seed, window), seed=31)
    wide = window - min(seed, window) + 1
    n = len(w) - window + 1
    if n <= 0:
        return g, np.zeros(0, np.int64)
    low, at = g[:n].copy(), np.arange(n)
    for j in range(1, wide):
        x = g[j : j + n]
        less = x < low
        low[less] = x[less]
        at[less] = np.flatnonzero(less) + j
    return g, at


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _read(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, row = C.WordHash(), 0
        task = TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column(1).to_pylist()
                digest, n, sha, keys = [], [], [], []
                for t in texts:
                    words = (t or b"").split()
                    digest.append(xxhash.xxh3_128_digest(t or b""))
                    n.append(len(words))
                    sha.append(_sha(words))
                    g, s = seeds(cache.of(words), window)
                    keys.append(g[np.unique(s)].view(np.int64) if len(s) else np.zeros(0, np.int64))
                uid = np.arange(row, row + len(texts)) + (task << 33)
                row += len(texts)
                yield pa.RecordBatch.from_arrays([pa.array(uid), part.column(0), pa.array(digest, pa.binary()), pa.array(n, pa.int64()), pa.array(sha), pa.array(keys, pa.list_(pa.int64())), part.column(1)], ["uid", "doc_id", "digest", "n_words", "sha", "seeds", "text"])

    return run


def strands(w: np.ndarray, few: np.ndarray, many: np.ndarray, window: int = WINDOW, seed: int = SEED) -> list[tuple[int, int, int, int, bool]]:
    """(prefix, place of the seed, first window, last window, lengthened) of a text's windows under prefixes of two kinds.

    Windows under a common prefix are filed under a longer one: half of the way to the whole window, to the right of the
    seed where the window reaches that far, else to the left.
    """
    g, at = seeds(w, window, seed)
    if not len(at):
        return []
    seed = min(seed, window)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(at) - 1]])
    place = at[first]
    key = g[place].view(np.int64)
    out = [(*x, False) for i in np.flatnonzero(np.isin(key, few)) for x in [(int(key[i]), int(place[i]), int(first[i]), int(last[i]))]]
    common = np.flatnonzero(np.isin(key, many))
    if len(common):
        more = (window - seed) // 2
        right, left = (C.grams(w, seed + more, seed=x).view(np.int64) for x in (33, 34))
        for i in common.tolist():
            s, lo, hi = int(place[i]), int(first[i]), int(last[i])
            turn = s - (window - seed - more)  # the first window that reaches as far to the right
            if hi >= turn:
                out.append((int(right[s]), s, max(lo, turn), hi, True))
            if lo < turn:
                out.append((int(left[s - more]), s, lo, min(hi, turn - 1), True))
    return out


STRAND = "key long, longer boolean, doc_id long, uid long, place int, first int, n int, words binary"


def _strands(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = C.WordHash()
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        names = [x.split()[0] for x in STRAND.split(", ")]
        rows: list[tuple] = []
        for batch in batches:
            for uid, doc_id, text, few, many in zip(*(batch.column(c).to_pylist() for c in ("uid", "doc_id", "text", "few", "many")), strict=True):
                words = text.split()
                for key, s, lo, hi, longer in strands(cache.of(words), np.array(few, np.int64), np.array(many, np.int64), window):
                    rows.append((key, longer, FIRST if doc_id is None else doc_id, uid, s, lo, hi - lo + 1, b" ".join(words[lo : hi + window])))
                    if len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


class Tree:
    """The suffix tree of sorted rows of word numbers, kept as their order and common prefix lengths."""

    def __init__(self, rows: np.ndarray, group: np.ndarray | None = None):
        columns = [rows[:, i] for i in range(rows.shape[1] - 1, -1, -1)]
        self.order = np.lexsort(columns if group is None else [*columns, group])
        x = rows[self.order]
        differ = np.concatenate([x[1:] != x[:-1], np.ones((max(len(x) - 1, 0), 1), bool)], axis=1)
        #: words that each row has in common with the one before it in order; of different groups none
        self.common = np.concatenate([[-1], differ.argmax(axis=1)])[: len(x)]
        if group is not None and len(x):
            g = group[self.order]
            self.common[1:][g[1:] != g[:-1]] = -1
        deep = np.maximum(self.common, np.append(self.common[1:], -1))
        #: by row: depth of the deepest internal node above its leaf
        self.deepest = np.empty(len(x), np.int64)
        self.deepest[self.order] = deep

    def nodes(self, depth: int) -> np.ndarray:
        """By row the number of the node that its path meets at this depth."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.cumsum(self.common < depth)
        return out


def later_windows(key: np.ndarray, place: np.ndarray, first: np.ndarray, n: np.ndarray, words: list[bytes], window: int = WINDOW, seed: int = SEED) -> np.ndarray:
    """For strands in order of their documents and places: bit l is set if the window that starts l words before the seed is not the first of its words."""
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    flat = np.fromiter(map(numbers.__getitem__, b" ".join(words).split()), np.int32)
    seed = min(seed, window)
    size = n + window - 1
    begin = np.cumsum(size) - size
    left = place - first  # words of the strand before its seed
    at = begin + left
    j = np.arange(window)
    ahead = np.where(j < (size - left)[:, None], flat[np.minimum(at[:, None] + j, len(flat) - 1)], -1)
    back = np.arange(1, window - seed + 1)
    behind = np.where(back <= left[:, None], flat[np.maximum(at[:, None] - back, 0)], -1)
    forward, backward = Tree(ahead, key), Tree(behind)
    out = np.zeros(len(key), np.int64)
    for l in range(window - seed + 1):
        some = np.flatnonzero((left - n < l) & (l <= left) & (forward.deepest >= window - l) & (backward.deepest >= l))
        if len(some):
            both = (forward.nodes(window - l)[some] << 32) | backward.nodes(l)[some]
            lead = np.zeros(len(some), bool)
            lead[np.unique(both, return_index=True)[1]] = True
            out[some[~lead]] |= 1 << l
    return out


def _subtrees(window: int):
    """(uid, place, later) of strands that come in order of their prefixes: whole groups at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(t: pa.Table) -> pa.RecordBatch:
            t = t.sort_by([("doc_id", "ascending"), ("uid", "ascending"), ("first", "ascending")])
            num = lambda c: t.column(c).to_numpy().astype(np.int64)
            later = later_windows(num("key"), num("place"), num("first"), num("n"), t.column("words").to_pylist(), window)
            some = later != 0
            return pa.RecordBatch.from_arrays([pa.array(num("uid")[some]), pa.array(num("place")[some].astype(np.int32)), pa.array(later[some])], ["uid", "place", "later"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= CHUNK:
                t = pa.Table.from_batches(held)
                keys = t.column("key").to_numpy()
                cut = int(np.searchsorted(keys, keys[-1]))  # the last group may go on
                if cut:
                    yield done(t.slice(0, cut))
                held = t.slice(cut).to_batches()
        if held and (t := pa.Table.from_batches(held)).num_rows:
            yield done(t)

    return run


def _windows(window: int):
    """(a, b, doc_id, uid, start) of the windows of strands: the 128-bit hash of the words, and where they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [[], [], [], []]
            hashes = []
            for doc_id, uid, first, n, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "uid", "first", "n", "words")), strict=True):
                words = text.split()
                hashes += [xxhash.xxh3_128_digest(b" ".join(words[i : i + window])) for i in range(n)]
                for c, x in zip(cols, ([doc_id] * n, [uid] * n, range(first, first + n)), strict=False):
                    c.extend(x)
            h = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32())], ["a", "b", "doc_id", "uid", "start"])

    return run


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of n words lie in a window with one of these starts."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge[:-1]) > 0


def _cut(window: int, texts_too: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, sha, kept = [], [], []
            for text, places, later in zip(*(batch.column(c).to_pylist() for c in ("text", "places", "later")), strict=True):
                words = text.split()
                place, bits = np.array(places, np.int64), np.array(later, np.int64)
                starts = np.concatenate([(place - l)[bits >> l & 1 == 1] for l in range(window)])
                gone = covered(len(words), starts, window)
                stay = [words[i] for i in np.flatnonzero(~gone)]
                removed.append(int(gone.sum()))
                sha.append(_sha(stay))
                kept.append(b" ".join(stay).decode() if texts_too else None)
            yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(removed, pa.int64()), pa.array(sha), pa.array(kept, pa.string())], ["uid", "n_removed", "kept_sha256", "kept_text"])

    return run


def deduplicated(docs: DataFrame, window: int = WINDOW, texts_too: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_sha256 and kept_text (null unless texts_too and words went).

    Words are split at ASCII white space and compared as they are. A word goes if a window of `window` words
    covers it whose words also start earlier: in a smaller doc_id, or earlier in the same document. Null and
    empty texts have no words. Null ids come before all others; rows that repeat an id come in the order in
    which they are read. An empty table gives an empty result.
    """
    C.ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    t = C.written(rows.mapInArrow(C.lean(_read(window)), "uid long, doc_id long, digest binary, n_words long, sha string, seeds array<long>, text binary"), "suffix_docs")
    long = t.where(F.col("n_words") >= window)
    # of equal texts the first row stays in the trees; its place in order is (id, row)
    place = F.struct(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("doc_id"), "uid")
    firsts = C.written(long.groupBy("digest").agg(F.min(place).alias("p")).select(F.col("p.uid").alias("uid")), "firsts")
    tree = long.join(firsts, "uid", "left_semi")
    filed = C.written(tree.select("uid", F.explode("seeds").alias("seed")), "seeds")
    # a window's seed may stand twice in one document: such a run is filed once a place, so counts are of places
    again = C.written(filed.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed", (F.col("n") > MOST).alias("common")), "again")
    kept = lambda is_common: F.collect_set(F.when(F.col("common") == is_common, F.col("seed")))
    of_doc = C.written(filed.join(again, "seed").groupBy("uid").agg(kept(False).alias("few"), kept(True).alias("many")), "of_doc")
    C.dropped(filed), C.dropped(again)
    found = C.written(tree.select("uid", "doc_id", "text").join(of_doc, "uid").mapInArrow(C.lean(_strands(window)), STRAND), "strands")
    C.dropped(of_doc)
    # lengthened prefixes that are still too common become nodes as whole windows
    common = C.written(found.where("longer").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > MOST).select("key"), "common")
    later = found.join(common, "key", "left_anti").repartition("key").sortWithinPartitions("key").mapInArrow(C.lean(_subtrees(window)), "uid long, place int, later long")
    later = C.written(later, "later")
    hot = found.where("longer").join(common, "key", "left_semi").select("words", (F.col("place") - F.col("first")).alias("left"), "n", "doc_id", "uid", "first", "place")
    # of equal strands the first alone is cut into windows; all windows of the others are repeats
    same = ["words", "left", "n"]
    heads = C.written(hot.groupBy(*same).agg(F.min(F.struct("doc_id", "uid", "first")).alias("p")).select(*same, "p.*"), "heads")
    again = hot.join(heads.select(*same, F.col("uid").alias("of"), F.col("first").alias("at")), same).where("uid != of or first != at")
    again = C.written(again.select("uid", "place", F.expr("shiftleft(shiftleft(1L, n) - 1, left - n + 1)").alias("later")), "again")
    windows = C.written(heads.mapInArrow(C.lean(_windows(window)), "a long, b long, doc_id long, uid long, start int"), "windows")
    for x in (found, common, heads):
        C.dropped(x)
    nodes = windows.groupBy("a", "b").agg(F.min(F.struct("doc_id", "uid", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    nodes = C.written(nodes.select("a", "b", F.col("first.uid").alias("first_uid"), F.col("first.start").alias("first_start")), "nodes")
    others = windows.join(nodes, ["a", "b"]).where("uid != first_uid or start != first_start").select("uid", F.col("start").alias("place"), F.lit(1).cast("long").alias("later"))
    # a list for each document, in its order
    by_doc = C.written(later.unionByName(again).unionByName(others).groupBy("uid").agg(F.collect_list("place").alias("places"), F.collect_list("later").alias("later")), "by_doc")
    for x in (later, again, windows, nodes):
        C.dropped(x)
    cut = t.select("uid", "text").join(by_doc, "uid").mapInArrow(C.lean(_cut(window, texts_too)), "uid long, n_removed long, kept_sha256 string, kept_text string")
    cut = C.written(cut, "cut")
    out = t.select("uid", "doc_id", "n_words", "sha").join(cut, "uid", "left").join(firsts.withColumn("first", F.lit(True)), "uid", "left")
    whole = F.col("first").isNull() & (F.col("n_words") >= window)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("doc_id", "n_words", F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"), F.when(whole, nothing).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"), F.when(whole, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"))
