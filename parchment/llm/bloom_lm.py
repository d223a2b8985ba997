"""Language-model scoring with a log-frequency Bloom filter.

Counts of word pairs are quantised on a logarithmic scale; a pair of level q is put into the filter once for
each level up to q, and its level is read back by probing level after level until a probe fails. Probabilities
mix the pair's relative frequency with the smoothed word probability, whose counts are exact.

Scale: texts are packed into chunks of bounded size; a chunk's distinct words, not its documents' words, are
joined with the corpus counts. The filter grows with the corpus: pairs are dealt by hash to shards, one for each
`SHARD_BYTES` of text, and a chunk's distinct pairs go to their shards once, packed, with their counts in training
texts. A shard has every occurrence of its pairs: it adds up the counts, builds its segments of 1 MB, reads the
levels of the pairs asked for and sends them back to their chunks. Nothing is broadcast and no pair is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

CHUNK_BYTES, CHUNK_DOCS = 8 << 20, 20_000
SHARD_BYTES = 16 << 20
#: Pairs whose places in the filter are worked out at a time.
SLICE = 1 << 16
SEGMENT_BITS = 1 << 23
BITS_A_LEVEL, PROBES = 12, 6
BASE = 1.5
PAIR_WEIGHT = 0.6
MOST_LEVELS = 80
END = b""


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, held_out, text) to chunks (chunk, ids, held, size, texts): lower-cased texts, length-prefixed, compressed."""
    task, seq = TaskContext.get().partitionId(), 0
    ids, held, texts, size = [], [], [], 0

    def out() -> pa.RecordBatch:
        raw = b"".join([np.array([len(texts), *map(len, texts)], np.int64).tobytes(), *texts])
        return pa.RecordBatch.from_arrays([pa.array([task << 32 | seq]), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())), pa.array([len(raw)]), pa.array([pa.compress(raw, codec="zstd", asbytes=True)])], ["chunk", "ids", "held", "size", "texts"])

    for batch in batches:
        for i, h, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            t = (t or b"").lower()
            ids.append(i), held.append(h), texts.append(t)
            size += len(t)
            if size >= CHUNK_BYTES or len(ids) >= CHUNK_DOCS:
                yield out()
                ids, held, texts, size, seq = [], [], [], 0, seq + 1
    if ids:
        yield out()


def unpacked(raw: bytes, size: int) -> list[bytes]:
    raw = pa.decompress(raw, decompressed_size=size, codec="zstd", asbytes=True)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    ends = 8 * (n + 1) + np.cumsum(np.concatenate([[0], np.frombuffer(raw, np.int64, n, 8)]))
    return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def pair_hashes(w: np.ndarray, before: np.ndarray) -> np.ndarray:
    m = C.odd(21, 2)
    return C.mixed(before * m[0] + w * m[1])


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk the distinct words with their counts in training texts (0 for words of held-out texts alone)."""
    for batch in batches:
        for row in batch.to_pylist():
            n: dict[bytes, int] = {END: 0}
            for text, held in zip(unpacked(row["texts"], row["size"]), row["held"], strict=True):
                one = 0 if held else 1
                for w in text.split():
                    n[w] = n.get(w, 0) + one
                n[END] += one
            yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]] * len(n)), pa.array(list(n), pa.binary()), pa.array(list(n.values()))], ["chunk", "word", "n"])


def _pairs(shards: int):
    """Rows (chunk, shard, pairs, n): a chunk's distinct pairs in order, cut by shard, and how often training texts hold each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, end = C.WordHash(), np.uint64(xxhash.xxh3_64_intdigest(END))
        for batch in batches:
            for row in batch.to_pylist():
                got: tuple[list, list] = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
                for text, held in zip(unpacked(row["texts"], row["size"]), row["held"], strict=True):
                    w = np.concatenate([[end], cache.of(text.split()), [end]]).astype(np.uint64)
                    got[bool(held)].append(pair_hashes(w[1:], w[:-1]))
                taught, times = np.unique(np.concatenate(got[0]), return_counts=True)
                pairs = np.union1d(taught, np.concatenate(got[1]))
                n = np.zeros(len(pairs), np.uint32)
                n[np.searchsorted(pairs, taught)] = times
                cuts = np.searchsorted(segment_of(pairs, shards), np.arange(shards + 1))
                some = np.flatnonzero(np.diff(cuts))
                cut = lambda x, some=some, cuts=cuts: pa.array([x[cuts[i] : cuts[i + 1]].tobytes() for i in some], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]] * len(some), pa.int64()), pa.array(some), cut(pairs), cut(n)], ["chunk", "shard", "pairs", "n"])

    return run


def levels(n: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(n, 1)) / math.log(BASE) + 1e-9).astype(np.int64)


def level_counts() -> np.ndarray:
    """The count that each level stands for: the geometric mean of its least and greatest count, so 1, 2 and 3 are exact; 0 at level 0."""
    ends = np.ceil(BASE ** np.arange(MOST_LEVELS) - 1e-9)
    return np.concatenate([[0.0], np.sqrt(ends[:-1] * (ends[1:] - 1))])


def segment_of(h: np.ndarray, segments: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)


def bit_places(h: np.ndarray, level: np.ndarray | int) -> np.ndarray:
    """(len(h), PROBES) places in a segment for the members (h, level)."""
    x = C.mixed(h + np.asarray(level, np.uint64) * np.uint64(0xD1342543DE82EF95))
    step = C.mixed(x) | np.uint64(1)
    return ((x[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64(SEGMENT_BITS - 1)).astype(np.int64)


def filter_of(h: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Packed segments that hold the pairs h, each at all levels up to its q."""
    segments = math.ceil(int(q.sum()) * BITS_A_LEVEL / SEGMENT_BITS)
    out = np.zeros((segments, SEGMENT_BITS // 8), np.uint8)
    row = segment_of(h, segments)
    for i in range(segments):
        own, top = h[row == i], q[row == i]
        bits = np.zeros(SEGMENT_BITS, np.uint8)
        for level in range(1, int(top.max(initial=0)) + 1):
            some = own[top >= level]
            for k in range(0, len(some), SLICE):
                bits[bit_places(some[k : k + SLICE], level).ravel()] = 1
        out[i] = np.packbits(bits)
    return out


def read_levels(bits: np.ndarray, base: int, segments: int, h: np.ndarray) -> np.ndarray:
    """The level of each pair, 0 if it is in no level: repeated probes of the segments base, base + 1, ..."""
    row = segment_of(h, segments) - base
    level = np.zeros(len(h), np.int64)
    alive = np.arange(len(h))
    for q in range(1, MOST_LEVELS):
        p = bit_places(h[alive], q)
        alive = alive[((bits[row[alive][:, None], p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1).all(axis=1)]
        if not len(alive):
            break
        level[alive] = q
    return level


def _shard(t: pa.Table) -> pa.Table:
    """(chunk, shard, levels) of a shard's rows of _pairs: the level of each pair, a byte each, in their order."""
    parts = [np.frombuffer(x, np.uint64) for x in t.column("pairs").to_pylist()]
    n = np.concatenate([np.frombuffer(x, np.uint32) for x in t.column("n").to_pylist()])
    h, back = np.unique(np.concatenate(parts), return_inverse=True)
    n = np.bincount(back, weights=n, minlength=len(h)).astype(np.int64)
    h = C.mixed(h)  # pairs of a shard share their first bits, by which segments are chosen
    bits = filter_of(h[n > 0], levels(n[n > 0]))
    level = np.zeros(len(h), np.uint8)
    for k in range(0, len(h) if len(bits) else 0, SLICE):
        level[k : k + SLICE] = read_levels(bits, 0, len(bits), h[k : k + SLICE])
    level = level[back]
    ends = np.cumsum([len(x) for x in parts])
    return pa.table({"chunk": t.column("chunk"), "shard": t.column("shard"), "levels": pa.array([level[b - len(x) : b].tobytes() for x, b in zip(parts, ends, strict=True)], pa.binary())})


def _score(n_all: int, n_words: int):
    """Scores of chunks from their words' counts and, in rows of the same table without a word, their pairs' levels."""
    stands_for = level_counts()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        read = right.filter(pc.is_valid(right.column("levels"))).sort_by("shard").column("levels").to_pylist()
        right = right.filter(pc.is_valid(right.column("word")))
        words = right.column("word").to_pylist()
        place = dict(zip(words, range(len(words)), strict=True))
        counts = right.column("c").to_numpy()
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        out = []
        for row in left.to_pylist():
            texts = unpacked(row["texts"], row["size"])
            end = place[END]
            at, lens = [], []
            for t in texts:
                w = t.split()
                lens.append(len(w) + 1)
                at.append(np.fromiter(map(place.__getitem__, w), np.int64, len(w)))
                at.append(np.array([end]))
            at = np.concatenate(at)
            lens = np.array(lens)
            starts = np.cumsum(lens) - lens
            c = counts[at]
            p1 = (c + 1) / (n_all + n_words + 1)
            before = np.roll(at, 1)
            before[starts] = end
            h = pair_hashes(hashes[at], hashes[before])
            pairs, back = np.unique(h, return_inverse=True)
            level = np.frombuffer(b"".join(read), np.uint8)
            if len(level) != len(pairs):
                raise ValueError(f"chunk {row['chunk']}: {len(level)} levels of {len(pairs)} pairs")
            cb = counts[before]
            pair = np.minimum(stands_for[level[back]], np.minimum(cb, c))
            p = np.where(cb > 0, PAIR_WEIGHT * pair / np.maximum(cb, 1) + (1 - PAIR_WEIGHT) * p1, p1)
            add = lambda x, s=starts: np.add.reduceat(x, s)
            out.append(pa.table({"chunk": pa.array([row["chunk"]] * len(texts)), "i": pa.array(np.arange(len(texts))), "doc_id": pa.array(row["ids"], pa.int64()), "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": pa.array(lens), "n_known": pa.array(add((c > 0).astype(np.int64))), "base_score": pa.array(add(np.log10(p1))), "score": pa.array(add(np.log10(p)))}))
        return pa.concat_tables(out) if out else pa.table({n: pa.array([], t) for n, t in (("chunk", pa.int64()), ("i", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))})

    return run


def scored(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    Tokens: A-Z lower-cased words split at ASCII white space, then one end. A null text is empty: its end alone.
    Repeated rows teach and are scored once each; null ids are kept; an empty table gives an empty result.
    Without training rows every count is 0 and both scores are those of the smoothed word model.
    """
    spark = docs.sparkSession
    C.ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held"), F.col(text_col).cast("binary").alias("text"))
    chunks = C.written(rows.mapInArrow(C.lean(packed), "chunk long, ids array<long>, held array<boolean>, size long, texts binary"), "chunks")
    shards = math.ceil((chunks.agg(F.sum("size")).first()[0] or 1) / SHARD_BYTES)
    asked = chunks.mapInArrow(C.lean(_pairs(shards)), "chunk long, shard long, pairs binary, n binary")
    read = C.written(asked.groupBy("shard").applyInArrow(_shard, "chunk long, shard long, levels binary"), "levels")
    words = C.written(chunks.mapInArrow(C.lean(_vocabulary), "chunk long, word binary, n long"), "words")
    counts = C.written(words.groupBy("word").agg(F.sum("n").alias("c")), "counts")
    n_all, n_words = counts.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    known = words.join(counts, "word").select("chunk", "word", "c")
    known = known.unionByName(read, allowMissingColumns=True)
    kind = "chunk long, i long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    out = C.written(chunks.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_score(n_all, n_words), kind), "scores")
    for t in (chunks, words, counts, read):
        C.dropped(t)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")
