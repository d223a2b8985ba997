"""SentencePiece encoding and decoding by a batched numpy Viterbi search.

Words of equal length advance together, one column of characters at a time: hashes of all substrings probe the
sorted hashes of the pieces, and the best last piece of each prefix is kept as a back pointer. For a unigram
model the best is the largest sum of scores. For a merge (BPE) model a prefix's last piece is the one whose
boundary no merge would have crossed; whether a merge crosses the boundary of two pieces is worked out for
all pairs of a batch at once, by undoing their merges from the last to the first. Both give the ids that the
model's own library gives.

Scale: a narrow map over the documents; a worker holds the pieces and a bounded memory of words.
"""

from __future__ import annotations

import hashlib
import re
import string
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
MULT = np.uint64(0x9E3779B97F4A7C55)
#: First bits of a hash that place it in a table.
BITS = 20
SHIFT = np.uint64(64 - BITS)
MOST_WORDS = 300_000
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
NEVER = np.iinfo(np.int64).max


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        x = shift = 0
        while True:
            x |= (data[i] & 127) << shift
            i, shift = i + 1, shift + 7
            if data[i - 1] < 128:
                return x

    while i < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[i : i + n]
            i += n


@dataclass
class Pieces:
    """A model's pieces: texts, scores and kinds by id, and sorted hash keys of those that text can match."""

    texts: list[str]
    scores: np.ndarray
    kinds: list[int]
    model_type: int = BPE
    dummy_prefix: bool = True
    keys: np.ndarray = field(init=False)
    ids: np.ndarray = field(init=False)
    left: np.ndarray = field(init=False)
    right: np.ndarray = field(init=False)
    hashes: np.ndarray = field(init=False)
    lens: np.ndarray = field(init=False)
    rank: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        n = len(self.texts)
        self.lens = np.array([len(t) for t in self.texts])
        self.hashes = np.array([text_hash(t) for t in self.texts], np.uint64)
        self.left, self.right = np.full(n, -1), np.full(n, -1)
        self.byte0 = next((i for i, k in enumerate(self.kinds) if k == BYTE), -1)
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        good = np.array([k in (NORMAL, USER, UNUSED) for k in self.kinds], bool)
        self.lookup = {t: i for i, t in enumerate(self.texts) if good[i]}
        order = np.lexsort((np.arange(n), -self.scores))
        self.rank = np.empty(n, np.int64)
        self.rank[order] = np.arange(n)
        if self.model_type == BPE:
            for i in np.flatnonzero(good & (self.lens > 1)):
                got, self.left[i], self.right[i] = self.merged(self.texts[i])
                good[i] = got == [self.texts[i]]
        self.reachable = good
        self.match = np.array([self.texts[i] in self.lookup for i in range(n)]) & np.array([k in (NORMAL, USER, UNUSED) for k in self.kinds])
        ids = np.flatnonzero(self.match)
        order = np.argsort(self.hashes[ids])
        self.keys, self.ids = self.hashes[ids][order], ids[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one hash")
        # a table by the first bits of the hash; keys that share them with another are searched in order
        self.slots = np.full(1 << BITS, -1)
        slot = (self.keys >> SHIFT).astype(np.int64)
        self.slots[slot] = self.ids
        crowded = np.bincount(slot, minlength=1 << BITS)[slot] > 1
        self.crowded, self.crowded_ids = np.append(self.keys[crowded], np.uint64(2**64 - 1)), np.append(self.ids[crowded], -1)
        #: pairs of adjacent pieces worked out before, by hash; a later pair takes the place of an earlier one
        self.pair_codes, self.pair_fits = np.full(1 << BITS, -1), np.zeros(1 << BITS, bool)
        self.powers = np.array([pow(int(MULT), k, 1 << 64) for k in range(int(self.lens[ids].max(initial=1)) + 1)], np.uint64)
        self.longest = int(self.lens[ids].max(initial=1))
        # no piece joins two characters where the text is split, so parts are independent
        pairs = {a + b for t in self.lookup for a, b in zip(t, t[1:], strict=False)}
        letter = re.compile(r"[^\W\d_]")
        line = "" if any("\n" in x for x in pairs) else "\n"
        tied = {b if letter.match(a) else a for a, b in pairs if bool(letter.match(a)) != bool(letter.match(b))}
        free = "".join(re.escape(c) for c in string.punctuation if c not in tied)
        stop = f"(?=[{SPACE}{line}{free}]|$)"
        kinds = [rf"[^\W\d_]++{stop}", *([rf"[{free}]++(?=[{SPACE}{line}]|[^\W\d_]|$)"] if free else []), f"[^{SPACE}{line}]+"]
        self.splitter = re.compile("|".join([*(f"{SPACE}*+{k}" for k in kinds), f"{SPACE}+", *([line] if line else [])]))
        if any(SPACE in t.lstrip(SPACE) for t in self.lookup):
            raise ValueError("a piece holds a space after other characters: words are not independent")
        self.out = [bytes([int(t[1:-1], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else t.replace(SPACE, " ").encode() for t, k in zip(self.texts, self.kinds, strict=True)]

    def merged(self, text: str) -> tuple[list[str], int, int]:
        """Plain merging of one text: always the best-scored pair, leftmost of equals; and the ids of the last merge."""
        parts, a, b = list(text), -1, -1
        while True:
            best = max(((self.scores[i], -k) for k in range(len(parts) - 1) if (i := self.lookup.get(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None:
                return parts, a, b
            k = -best[1]
            a, b = self.lookup.get(parts[k], -1), self.lookup.get(parts[k + 1], -1)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, -1 for none: a probe of a table by the hash's first bits, then the sorted keys of those that share them."""
        out = self.slots[(h >> SHIFT).astype(np.int64)]
        some = np.flatnonzero(out.ravel() != -1)
        x, flat = h.ravel()[some], out.ravel()
        got = flat[some]
        wrong = self.hashes[got] != x
        if wrong.any():
            y = x[wrong]
            at = np.minimum(np.searchsorted(self.crowded, y), len(self.crowded) - 1)
            got[wrong] = np.where(self.crowded[at] == y, self.crowded_ids[at], -1)
            flat[some] = got
        return flat.reshape(h.shape)

    def fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """uncrossed(a, b), with what earlier calls found out."""
        code = a * len(self.texts) + b
        slot = (code.astype(np.uint64) * MULT >> SHIFT).astype(np.int64)
        ok = self.pair_fits[slot]
        miss = np.flatnonzero(self.pair_codes[slot] != code)
        if len(miss):
            new, back = np.unique(code[miss], return_inverse=True)
            fits = self.uncrossed(new // len(self.texts), new % len(self.texts))
            ok[miss] = fits[back]
            self.pair_codes[slot[miss]], self.pair_fits[slot[miss]] = code[miss], ok[miss]
        return ok

    def uncrossed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of adjacent pieces: no merge crosses their boundary. Undoes the later of their last merges, again and again."""
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b, limit = a.copy(), b.copy(), np.full(len(a), NEVER)
        while len(live):
            both = self.find(self.hashes[a] * self.powers[self.lens[b]] + self.hashes[b])
            crossed = (both >= 0) & (self.rank[both] < limit)
            ok[live[crossed]] = False
            ra = np.where(self.left[a] < 0, -1, self.rank[a])
            rb = np.where(self.left[b] < 0, -1, self.rank[b])
            undo_a = ra > rb
            done = crossed | ((ra < 0) & (rb < 0))
            # at equal rank the pair further left merges first: a's own merge before the crossing one, b's after it
            limit = np.where(undo_a, ra, rb + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
            live, a, b, limit = live[~done], a[~done], b[~done], limit[~done]
        return ok

    def search(self, words: list[str]) -> np.ndarray:
        """Ids of words of one length, at their starts in a row a word (-1 elsewhere): Viterbi over all of them at once."""
        n, size = len(words), len(words[0])
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(n, size).astype(np.uint64)
        h = np.zeros((n, size + 1), np.uint64)
        for i in range(size):
            h[:, i + 1] = h[:, i] * MULT + code[:, i] + np.uint64(1)
        most = min(self.longest, size)
        if self.model_type == BPE:
            return self._boundaries(h, n, size, most)
        # piece[l - 1][:, s]: the piece of length l from s, -1 for none; a character that is no piece is -2
        piece = []
        for k in range(1, most + 1):
            p = self.find(h[:, k:] - h[:, :-k] * self.powers[k])
            piece.append(np.where(p < 0, -2, p) if k == 1 else p)
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0
        back, last = np.zeros((n, size + 1), np.int64), np.full((n, size + 1), -3)
        low = self.scores[self.ids].min() - 10
        for e in range(1, size + 1):
            for k in range(1, min(most, e) + 1):
                p = piece[k - 1][:, e - k]
                s = best[:, e - k] + np.where(p >= 0, self.scores[p], low if k == 1 else -np.inf)
                better = s > best[:, e]
                best[better, e], back[better, e], last[better, e] = s[better], k, p[better]
        return self._traced(last, back, n, size)

    def _boundaries(self, h: np.ndarray, n: int, size: int, most: int) -> np.ndarray:
        """For each prefix of all words the last piece: the one that fits behind the last piece of what is before it."""
        back, last = np.zeros((n, size + 1), np.int64), np.full((n, size + 1), -3)
        for e in range(1, size + 1):
            k = min(most, e)
            p = self.find(h[:, e, None] - h[:, e - k : e][:, ::-1] * self.powers[None, 1 : k + 1])
            p[(p >= 0) & ~self.reachable[p]] = -1
            p[p[:, 0] < 0, 0] = -2
            rows, lens = np.nonzero(p != -1)
            lens += 1
            p, q = p[rows, lens - 1], last[rows, e - lens]
            fits = (lens == e) | (q == -2) | (p == -2)
            open_ = np.flatnonzero(~fits & (q >= 0))
            fits[open_] = self.fit(q[open_], p[open_])
            back[rows[fits], e], last[rows[fits], e] = lens[fits], p[fits]
        return self._traced(last, back, n, size)

    def _traced(self, last: np.ndarray, back: np.ndarray, n: int, size: int) -> np.ndarray:
        """Follow the back pointers of all words together; -2 - s stands for the character at s that is no piece."""
        out = np.full((n, size), -1)
        rows, e = np.arange(n), np.full(n, size)
        while len(rows):
            s, p = e - back[rows, e], last[rows, e]
            out[rows, s] = np.where(p == -2, -2 - s, p)
            rows, e = rows[s > 0], s[s > 0]
        return out

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words as little-endian 32-bit bytes."""
        out: list[bytes] = [b""] * len(words)
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if self.model_type == BPE and w.startswith(SPACE * 2):  # pieces of spaces share a score: merge plainly
                out[i] = self._plain(w)
            else:
                by.setdefault(len(w), []).append(i)
        for size, at in by.items():
            step = max(1, 60_000 // size)
            for a in range(0, len(at), step):
                some = at[a : a + step]
                got = self.search([words[i] for i in some])
                used = got != -1
                flat, ends = got[used].astype("<i4").tobytes(), 4 * np.concatenate([[0], np.cumsum(used.sum(axis=1))])
                ends = ends.tolist()
                for i, x, y in zip(some, ends, ends[1:], strict=False):
                    out[i] = flat[x:y]
                for r in np.flatnonzero((got < -1).any(axis=1)):
                    ids = [[x] if x >= 0 else self._odd(words[some[r]][-2 - x]) for x in got[r][used[r]]]
                    out[some[r]] = np.concatenate(ids).astype("<i4").tobytes()
        return out

    def _odd(self, char: str) -> list[int]:
        return [self.byte0 + b for b in char.encode()] if self.byte0 >= 0 else [self.unknown]

    def _plain(self, word: str) -> bytes:
        run = len(word) - len(word.lstrip(SPACE))
        long = [i for i in range(self.longest, 0, -1) if SPACE * i in self.lookup]
        if run > 4 * self.longest or len(word) - run > 64:  # only the end of a long run meets the word
            head = (run - 2 * self.longest) // long[0] * long[0]
            tail = self._plain(word[head:]) if head > 0 and self._even(long[0]) else None
            if tail is not None:
                return np.full(head // long[0], self.lookup[SPACE * long[0]], "<i4").tobytes() + tail
        ids: list[int] = []
        for p in self.merged(word)[0]:
            ids.extend([self.lookup[p]] if p in self.lookup else self._odd(p))
        return np.array(ids, "<i4").tobytes()

    def _even(self, n: int) -> bool:
        """A long run of spaces starts with the longest piece again and again."""
        if not hasattr(self, "_runs"):
            got = self.merged(SPACE * (5 * n))[0]
            self._runs = got == [SPACE * n] * 5
        return self._runs

    def encode_texts(self, texts: list[str | None], memory: dict[str, bytes]) -> list[bytes]:
        split = []
        for t in texts:
            t = (t or "").replace(" ", SPACE)
            split.append(self.splitter.findall(SPACE + t if t and self.dummy_prefix else t))
        now = set().union(*split)
        new = list(now.difference(memory))
        if len(memory) + len(new) > MOST_WORDS:  # what is in use now stays
            stay = {w: memory[w] for w in now.intersection(memory)}
            memory.clear()
            memory.update(stay)
        memory.update(zip(new, self.encode_words(new), strict=True))
        return [b"".join(map(memory.__getitem__, s)) for s in split]

    def decode(self, ids: np.ndarray) -> str:
        got = b"".join(map(self.out.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return got[1:] if self.dummy_prefix and got.startswith(" ") else got


def text_hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h * int(MULT) + ord(c) + 1) % (1 << 64)
    return h


def load(path: str = MODEL) -> Pieces:
    """Read a .model file on the driver."""
    with open(path, "rb") as f:
        data = f.read()
    texts, scores, kinds, model_type, prefix = [], [], [], UNIGRAM, True
    for number, value in _fields(data):
        if number == 1:
            p = dict(_fields(value))
            texts.append(p[1].decode())
            scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
            kinds.append(p.get(3, NORMAL))
        elif number == 2:
            model_type = dict(_fields(value)).get(3, UNIGRAM)
        elif number == 3:
            spec = dict(_fields(value))
            prefix = bool(spec.get(3, 1))
            if spec.get(2) or spec.get(4, 1):
                raise ValueError("only models that leave text as it is are supported")
    return Pieces(texts, np.array(scores), kinds, model_type, prefix)


def _lists(got: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, got)]).astype(np.int32)), pa.array(np.concatenate(got)))


def _encoder(pieces, also_decode: bool, digests: bool = True):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Pieces = pieces.value
        memory: dict[str, bytes] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(1).to_pylist()
                got = [np.frombuffer(b, "<i4") for b in model.encode_texts(texts, memory)]
                if not also_decode:
                    yield pa.RecordBatch.from_arrays([part.column(0), _lists(got)], ["row", "ids"])
                    continue
                back = [model.decode(g) for g in got]
                same = [b == (t or "") for b, t in zip(back, texts, strict=True)]
                if not digests:
                    yield pa.RecordBatch.from_arrays([part.column(0), _lists(got), pa.array(same)], ["row", "ids", "round_trip"])
                    continue
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, got), pa.int64()), pa.array([hashlib.sha256(g.tobytes()).hexdigest() for g in got]), pa.array([hashlib.sha256(b.encode()).hexdigest() for b in back]), pa.array(same)], ["row", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])

    return run


def _decoder(pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else pieces.value.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "text"])

    return run


def _run(df: DataFrame, value: str, f, kind: str) -> DataFrame:
    both = df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), df[f"`{value}`"].alias("value"))
    return both.mapInArrow(C.lean(f), f"row {both.schema['row'].dataType.simpleString()}, {kind}")


def _shared(spark: SparkSession, path: str):
    C.ship(spark)
    return spark.sparkContext.broadcast(load(path))


def encoded(docs: DataFrame, path: str = MODEL, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """All columns of docs but those named like ids_col, and array<int> ids of each whole text.

    Null and empty texts have no ids. Repeated rows are encoded each. A text's own U+2581 counts as a space.
    """
    out = _run(docs, text_col, _encoder(_shared(docs.sparkSession, path), False), "ids array<int>")
    return out.select(*[F.col(f"row.`{c}`") for c in docs.columns if c != ids_col], F.col("ids").alias(ids_col))


def decoded(rows: DataFrame, path: str = MODEL, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """All columns of rows but those named like text_col, and the text of each array of ids; null ids give null."""
    out = _run(rows, ids_col, _decoder(_shared(rows.sparkSession, path)), "text string")
    return out.select(*[F.col(f"row.`{c}`") for c in rows.columns if c != text_col], F.col("text").alias(text_col))


def encoded_and_checked(docs: DataFrame, path: str = MODEL, text_col: str = "text") -> DataFrame:
    """encoded(), and in the same pass round_trip: whether the ids decode to the text itself (null: the empty text)."""
    out = _run(docs, text_col, _encoder(_shared(docs.sparkSession, path), True, digests=False), "ids array<int>, round_trip boolean")
    return out.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in ("ids", "round_trip")], "ids", "round_trip")


def round_trips(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit), decoded_sha256, round_trip.

    round_trip: the decoded text is the text itself (null: the empty text), so it is false where a text has a U+2581 of its own.
    """
    out = _run(docs.select("doc_id", "text"), "text", _encoder(_shared(docs.sparkSession, path), True), "n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
    return out.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip")
