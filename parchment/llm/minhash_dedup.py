"""MinHash near-duplicate detection.

Method: many universal hash minima per document, cut into bands; bands that agree give candidate
links; signatures verify candidates, full shingle sets confirm them; connected components come from
alternating large-star and small-star steps.

Scale: documents with equal shingle sets are one class before any candidate is made, so groups of
exact copies cost one row. Each class first tries one link, to the smallest head (smallest class) of its
buckets, then the other heads from which it is still apart; what a bucket then holds beside its head's
component is compared in blocks of bounded bytes, where full sets are at hand and only links leave the
block. Pairs inside one component are never looked at, so a group of near copies costs about a link a member.
A member's full set is shuffled to its head's, which is sent once: no join carries a head's set for each
member. No group is gathered in one task, nothing but row counts reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BANDS, ROWS = 32, 5
#: A link at similarity 0.8 falls below this agreement of 160 minima with probability under 2e-6.
AGREE = 0.65
#: Classes of a bucket whose signatures are compared as one block, and bytes of full sets in one block.
BLOCK, BLOCK_BYTES = 500, 1 << 20
#: Bytes of full sets in one batch.
BATCH_BYTES = 4 << 20


def shingle_set(words: list[bytes], k: int, cache: C.WordHash) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of the whole sequence if it has fewer words; empty without words."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < k:
        return C.grams(cache.of(words), len(words), seed=100 + len(words))
    return np.unique(C.grams(cache.of(words), k))


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of len(a) multiply-add-shift hashes of the shingles."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    x = shingles >> np.uint64(32)
    for i in range(0, len(x), 2048):
        v = a[:, None] * x[None, i : i + 2048]
        v += b[:, None]
        np.minimum(low, v.min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def _text_words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def _sketches(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = C.WordHash()
        a, b = C.odd(1, bands * rows), C.odd(2, bands * rows)
        m = C.odd(3, rows)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n, digest, sig, keys = [], [], [], []
                for text in part.column(1).to_pylist():
                    s = shingle_set(_text_words(text), k, cache)
                    n.append(len(s))
                    if not len(s):
                        digest.append(None), sig.append(None), keys.append(None)
                        continue
                    digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                    v = signature(s, a, b)
                    sig.append(v.tobytes())
                    keys.append(C.mixed((v.reshape(bands, rows).astype(np.uint64) * m).sum(axis=1) + np.arange(bands, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "sig", "bands"])

    return run


def _sets(k: int):
    """(node, shingles) from (node, text, digest): sorted 64-bit hashes, in batches of bounded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = C.WordHash()
        for batch in batches:
            nodes, sets, size = [], [], 0
            for i in range(batch.num_rows):
                node, text, digest = (c[i].as_py() for c in batch.columns)
                s = shingle_set(_text_words(text), k, cache).tobytes()
                if xxhash.xxh3_128_digest(s) == digest:
                    nodes.append(node), sets.append(s)
                    size += len(s)
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "shingles"])
                    nodes, sets, size = [], [], 0
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "shingles"])

    return run


def shared(x: bytes, y: bytes) -> int:
    """How many hashes two sorted sets have in common."""
    a, b = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def _similar(percent: int):
    """The links of rows (a, b, set_a, set_b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = memoryview(x.as_buffer()), memoryview(y.as_buffer())
                both = shared(x, y)
                good.append(100 * both >= percent * ((len(x) + len(y)) // 8 - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _agree(agree: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("set_a").to_pylist()), np.uint32).reshape(batch.num_rows, -1)
            y = np.frombuffer(b"".join(batch.column("set_b").to_pylist()), np.uint32).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= agree))

    return run


def _compared(row: dict, agree: float, rows: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each class of block u the classes of block m to compare it with: of another component, signatures that agree, and no earlier band that both share."""
    mc = np.array([x["component"] for x in row["m"]], np.int64)
    ms = np.frombuffer(b"".join(x["sig"] for x in row["m"]), np.uint32).reshape(len(mc), -1)
    for i, x in enumerate(row["u"]):
        same = ms == np.frombuffer(x["sig"], np.uint32)
        at = np.flatnonzero((mc != x["component"]) & (same.mean(axis=1) >= agree))
        if len(at):
            at = at[same[at].reshape(len(at), -1, rows).all(axis=2).argmax(axis=1) == row["band"]]
        if len(at):
            yield i, at


def _block_near(agree: float, rows: int):
    """(key, node) of the classes that have anything to be compared with in their bucket: at most one row a class of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: c[i].as_py() for n, c in zip(batch.schema.names, batch.columns, strict=True)}
                keep: set[int] = set()
                for j, at in _compared(row, agree, rows):
                    keep.add(row["u"][j]["node"])
                    keep.update(row["m"][x]["node"] for x in at)
                if keep:
                    yield pa.RecordBatch.from_arrays([pa.array([row["key"]] * len(keep), pa.int64()), pa.array(keep, pa.int64())], ["key", "node"])

    return run


def _block_links(agree: float, percent: int, rows: int):
    """Links between classes of two blocks of one bucket that are of different components: one for each class and component.

    Signatures choose what to compare; a pair is compared in the first band that it shares alone; shared
    shingles are counted through an inverted file of the block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: c[r].as_py() for n, c in zip(batch.schema.names, batch.columns, strict=True)}
                u, m = row["u"], row["m"]
                mid, mc = (np.array([x[c] for x in m], np.int64) for c in ("node", "component"))
                sets = [np.frombuffer(x["shingles"], np.uint64) for x in m]
                sizes = np.array(list(map(len, sets)))
                flat = np.concatenate(sets)
                order = np.argsort(flat, kind="stable")
                keys, owner = flat[order], np.repeat(np.arange(len(m)), sizes)[order]
                got = []
                for i, at in _compared(row, agree, rows):
                    x = u[i]
                    s = np.frombuffer(x["shingles"], np.uint64)
                    low, high = np.searchsorted(keys, s, "left"), np.searchsorted(keys, s, "right")
                    lens = high - low
                    places = np.repeat(low - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
                    both = np.bincount(owner[places], minlength=len(m))[at]
                    linked = at[100 * both >= percent * (len(s) + sizes[at] - both)]
                    for c in np.unique(mc[linked], return_index=True)[1]:
                        other = int(mid[linked[c]])
                        got.append((min(x["node"], other), max(x["node"], other)))
                if got:
                    a, b = zip(*got, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of an undirected edge list (a, b), component the smallest node: alternating large-star and small-star.

    Each round is a shuffle of the edges by node with a partial minimum; it ends when a round changes no edge.
    """
    edges = C.written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    before = mark(edges)
    for _ in range(most_rounds):
        if not before[0]:
            break
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = near.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        after = C.written(small.distinct(), "edges")
        now = mark(after)
        C.dropped(edges)
        edges = after
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _with(pairs: DataFrame, rows: DataFrame, value: str) -> DataFrame:
    """Pairs with a value of each end. The member's (b, once or a few times in pairs) is moved to the head's (a, often many times), which is sent once."""
    for end in "ba":
        pairs = pairs.join(rows.select(F.col("node").alias(end), F.col(value).alias(f"set_{end}")), end)
    return pairs.select("a", "b", "set_a", "set_b")


def _sets_of(docs: DataFrame, classes: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(node, shingles) of classes, made again from the whole texts of rows with their smallest ids."""
    ids = nodes.distinct().join(classes.select("node", F.col("rep").alias("doc_id"), "digest"), "node")
    wanted = docs.join(ids, "doc_id").select("node", "text", "digest").mapInArrow(C.lean(_sets(k)), "node long, shingles binary")
    return C.written(wanted.dropDuplicates(["node"]), "sets")


def _confirmed(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose signatures agree and whose full shingle sets, made again from whole texts, are similar enough."""
    close = C.written(_with(pairs, classes, "sig").mapInArrow(C.lean(_agree(AGREE)), "a long, b long"), "close")
    sets = _sets_of(docs, classes, close.select(F.explode(F.array("a", "b")).alias("node")), k)
    links = C.written(_with(close, sets, "shingles").mapInArrow(C.lean(_similar(percent)), "a long, b long"), "links")
    C.dropped(sets), C.dropped(close)
    return links


def _placed(members: DataFrame, place: DataFrame) -> DataFrame:
    """The members of buckets with their components so far."""
    return C.written(members.join(place, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")


def _merged(place: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links: only the components that the links join are worked on."""
    if links.isEmpty():
        return place
    of = lambda end: place.select(F.col("node").alias(end), F.col("component").alias(f"{end}_is"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    edges = C.written(ends.select(F.coalesce("a_is", "a").alias("a"), F.coalesce("b_is", "b").alias("b")), "joined")
    joined = connected_components(edges)
    moved = joined.select(F.col("node").alias("component"), F.col("component").alias("new"))
    old = place.join(moved, "component", "left").select("node", F.coalesce("new", "component").alias("component"))
    out = C.written(old.unionByName(joined.join(place, "node", "left_anti")), "merged")
    C.dropped(edges)
    return out


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept.

    Two documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of k-word shingles (A-Z
    lower-cased, words split at ASCII white space; a shorter text is one shingle). Null or wordless texts have
    the empty set and no link. A row whose id is null is linked with nothing: component_id null, kept true.
    Rows that repeat an id are one node, whose texts each bring their own links. Other columns are ignored; an
    empty table gives an empty result.
    """
    C.ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    t = C.written(docs.mapInArrow(C.lean(_sketches(k, bands, rows)), "doc_id long, n_shingles long, digest binary, sig binary, bands array<long>"), "sketch")
    known = t.where("doc_id is not null and digest is not null")
    # a class is a set of shingles; its node is a number of its own, as classes may share their smallest id
    sorted_out = known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = C.written(sorted_out.withColumn("node", F.monotonically_increasing_id()), "classes")
    members = classes.select("node", F.posexplode("bands").alias("band", "key"))
    # counts are tables of their own before they are joined, so that rows of a common key can be split
    buckets = C.written(members.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub < top").select("key", "hub"), "buckets")
    members = C.written(members.join(buckets, "key"), "members")
    # first one link a class: to the smallest class that heads one of its buckets
    stars = C.written(members.where("node != hub").groupBy("node").agg(F.min("hub").alias("a")).select("a", F.col("node").alias("b")), "stars")
    # rows that repeat an id with different texts tie their classes together
    mark = known.select("doc_id", F.xxhash64("digest").alias("x")).groupBy("doc_id").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    again = known.select("doc_id", "digest").join(mark.where("lo != hi").select("doc_id"), "doc_id").join(classes.select("digest", "node"), "digest")
    ties = C.written(again.select("doc_id", "node").distinct(), "ties")
    ties = ties.join(ties.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").select("a", F.col("node").alias("b"))
    place = connected_components(_confirmed(docs, classes, stars, k, percent).unionByName(ties))
    placed = _placed(members, place)
    # then the other heads of its buckets, where they are still apart
    heads_of = placed.where("node = hub").select("key", F.col("component").alias("main"))
    apart = placed.where("node != hub").join(heads_of, "key").where("component != main")
    tried = C.written(apart.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct().join(stars, ["a", "b"], "left_anti"), "apart")
    C.dropped(placed)
    place = _merged(place, _confirmed(docs, classes, tried, k, percent))
    placed = _placed(members, place)
    # then what a bucket holds beside its head's component is compared in blocks
    hubs = placed.where("node = hub").select("key", F.col("component").alias("main"))
    found = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    open_keys = C.written(found.join(hubs, "key"), "open_keys")
    rows_ = C.written(placed.join(open_keys, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).select("key", "band", "block", "main", "node", "component"), "blocks")
    C.dropped(placed)
    # signatures first: only classes that have something to be compared with bring their full sets
    packed = lambda d, to, *cols: d.groupBy("key", "band", "block").agg(F.collect_list(F.struct("node", "component", *cols)).alias(to)).drop("block")
    met = lambda d, *cols: packed(d.where("component != main"), "u", *cols).join(packed(d, "m", *cols).drop("band"), "key").select("key", "band", "u", "m")
    sigs = classes.select("node", "sig")
    keep = C.written(met(rows_.join(sigs, "node"), "sig").mapInArrow(C.lean(_block_near(AGREE, rows)), "key long, node long").distinct(), "keep")
    full = _sets_of(docs, classes, keep.select("node"), k)
    near = rows_.drop("block").join(keep, ["key", "node"]).join(full.select("node", F.length("shingles").alias("size")), "node")
    dealt = near.groupBy("key").agg(F.ceil(F.sum("size") / BLOCK_BYTES).alias("blocks"))
    near = near.join(dealt, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).join(sigs, "node").join(full, "node")
    rest = C.written(met(near, "sig", "shingles").mapInArrow(C.lean(_block_links(AGREE, percent, rows)), "a long, b long").distinct(), "rest")
    found = _merged(place, rest)
    # a component's id is the smallest of its classes' smallest ids
    of_class = C.written(found.join(classes.select("node", "rep", "digest"), "node"), "found")
    least = C.written(of_class.groupBy("component").agg(F.min("rep").alias("least")), "least")
    ids = C.written(of_class.join(least, "component").select("digest", "least"), "ids")
    for x in (rows_, keep, full, rest, of_class, least, members, stars, buckets, open_keys):
        C.dropped(x)
    out = t.select("doc_id", "n_shingles", "digest").join(classes.select("digest", "rep").join(ids, "digest", "left"), "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
