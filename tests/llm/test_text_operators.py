"""Operators over documents: brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from parchment.llm import bloom_lm, minhash_dedup, pii_rules, quality_qda, sentence_pieces, suffix_dedup, tiling_decontamination
from parchment.llm.common import crc_mod

KIND = "doc_id long, text string, score double, row int, ids string, uid long, component_id string"
RNG = random.Random(5)
VOCAB = [f"w{i}" for i in range(300)]


def sentence(n):
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


def corpus():
    base = [sentence(RNG.randint(30, 120)) for _ in range(12)]
    texts = list(base)
    for t in base[:6]:
        w = t.split()
        texts += [t, t.upper(), " ".join(w[:5] + ["changed"] + w[6:]), "lead in " + t + "\n tail"]
    long = sentence(4000)
    texts += ["", None, " \n\t ", "one", "One", "two words", "a b c d", "A B\tC\nd", long, long + " more", sentence(25) * 2, "x" * 20000, "é ß 日本 😀"]
    return texts


@pytest.fixture(scope="module")
def rows():
    made = [(i * 3 % 101, t) for i, t in enumerate(corpus())]
    return made + [(None, made[0][1]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, 1, "x", 7, "y") for i, t in rows], KIND).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


def words(t):
    return (t or "").encode().lower().split()


def components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_minhash(docs, rows, none):
    got = minhash_dedup.near_duplicates(docs, k=4).collect()
    want = components([r for r in rows if r[0] is not None], 4, 80)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.component_id == r.doc_id)
    assert minhash_dedup.near_duplicates(none).count() == 0


def test_minhash_repeated_ids_and_blocks(spark, monkeypatch):
    """Rows that repeat an id tie their texts together; tiny blocks give the same components."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 2)
    a, b = sentence(60), sentence(60)
    near = [" ".join([*a.split()[:j], "q", *a.split()[j + 1 :]]) for j in range(0, 60, 6)]
    data = [(1, a), (1, b), (2, b), (5, b), *((10 + j, t) for j, t in enumerate(near))]
    monkeypatch.setattr(minhash_dedup, "BLOCK_BYTES", 1000)
    near_a, near_b = (" ".join([*t.split()[:30], "other", *t.split()[31:]]) for t in (a, b))
    data += [(6, near_a), (7, near_b)]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string").repartition(3), k=4).collect()
    assert {r.component_id for r in got if r.doc_id < 10} == {1}
    want = components([(i, t) for i, t in data if i >= 10] + [(1, a)], 4, 80)
    assert {r.doc_id: r.component_id for r in got if r.doc_id >= 10} == {i: c for i, (_, c) in want.items() if i >= 10}


def test_components(spark):
    pairs = [(a, b) for a, b in ((RNG.randrange(200), RNG.randrange(200)) for _ in range(120))] + [(i, i + 1) for i in range(1000, 1030)]
    up = {}

    def root(i):
        up.setdefault(i, i)
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in minhash_dedup.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: root(i) for i in up if any(i in p and p[0] != p[1] for p in pairs)}


@pytest.mark.parametrize("most", [4096, 2])
def test_substrings(docs, rows, none, most, monkeypatch):
    """Also with prefixes that are lengthened, to 14 words and to whole windows."""
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in suffix_dedup.deduplicated(docs).collect())
    seen, want = set(), collections.Counter()
    for i, t in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] is None)):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for j in range(len(w) - 19):
            key = tuple(w[j : j + 20])
            if key in seen:
                gone[j : j + 20] = [True] * 20
            seen.add(key)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[(i, len(w), sum(gone), hashlib.sha256(kept).hexdigest())] += 1
    assert got == want
    assert suffix_dedup.deduplicated(none).count() == 0


def test_language_model(docs, rows, none):
    got = collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in bloom_lm.scored(docs, crc_mod("doc_id", 7) == 2).collect())
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    count = collections.Counter()
    for i, t in rows:
        if not held(i):
            count.update([*words(t), b""])
    n, v = sum(count.values()), len(count)
    want = collections.Counter((i, held(i), len(words(t)) + 1, sum(count[w] > 0 for w in [*words(t), b""]), n, round(math.fsum(math.log10((count[w] + 1) / (n + v + 1)) for w in [*words(t), b""]), 6)) for i, t in rows)
    assert got == want
    assert bloom_lm.scored(none, F.lit(False)).count() == 0


def test_language_model_scores(docs, rows, monkeypatch):
    monkeypatch.setattr(bloom_lm, "SHARD_BYTES", 5000)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    count, pairs = collections.Counter(), collections.Counter()
    seen = [(i, held(i), [*words(t), b""]) for i, t in rows]
    for _, out, w in seen:
        if not out:
            count.update(w)
            pairs.update(zip([b"", *w], w, strict=False))
    n, v = sum(count.values()), len(count)

    def score(w, of):
        total = 0.0
        for a, b in zip([b"", *w], w, strict=False):
            p1 = (count[b] + 1) / (n + v + 1)
            total += math.log10(0.6 * min(of(pairs[a, b]), count[a], count[b]) / count[a] + 0.4 * p1 if count[a] else p1)
        return total

    def near(k):  # counts of one level are read as their geometric mean
        same = [x for x in range(1, 2 * k + 2) if bloom_lm.levels(x) == bloom_lm.levels(k)] if k else [0]
        return math.sqrt(same[0] * same[-1])

    got = bloom_lm.scored(docs, crc_mod("doc_id", 7) == 2).collect()
    left = collections.Counter((r.doc_id, round(r.score, 5)) for r in got)
    assert sum(k == 1 for k in pairs.values()) > 200
    assert left == collections.Counter((i, round(score(w, near), 5)) for i, _, w in seen)
    rare = [(i, w) for i, _, w in seen if count[b""] and max(pairs[p] for p in zip([b"", *w], w, strict=False)) <= 3]
    assert rare and all((i, round(score(w, int), 5)) in left for i, w in rare)


def test_bloom_levels():
    import numpy as np

    h = np.random.default_rng(1).integers(0, 2**63, 20000, dtype=np.uint64)
    n = np.random.default_rng(2).zipf(1.5, 20000).clip(2, 10**6)
    q = bloom_lm.levels(n)
    segments = math.ceil(q.sum() * bloom_lm.BITS_A_LEVEL / bloom_lm.SEGMENT_BITS)
    bits = np.zeros((segments, bloom_lm.SEGMENT_BITS), np.uint8)
    for level in range(1, q.max() + 1):
        some = h[q >= level]
        bits[bloom_lm.segment_of(some, segments)[:, None], bloom_lm.bit_places(some, level)] = 1
    bits = np.packbits(bits, axis=1)
    read = bloom_lm.read_levels(bits, 0, segments, h)
    assert (read >= q).all() and (read > q).mean() < 0.02
    other = np.random.default_rng(3).integers(0, 2**63, 20000, dtype=np.uint64)
    assert (bloom_lm.read_levels(bits, 0, segments, other) > 0).mean() < 0.02


def brute_spans(t):
    out = []
    luhn = lambda d: sum(int(c) if i % 2 == 0 else (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)] for i, c in enumerate(reversed(d))) % 10 == 0
    for k, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if k == "ip" and any(int(v) > 255 for v in m[0].split(".")) or k == "card" and not (13 <= len(d) <= 19 and luhn(d)) or k == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append(f"{k}:{m.start()}:{m.end()}")
    return out


def test_personal_data(spark):
    texts = ["", None, "a@b.c%d@e.f 1.2.3.4.5.6.7.8 001.002.3.255 256.1.1.1", "x" * 30000, "1" * 20000, "1." * 10000, "a@b" + ".c" * 10000, "4111 1111 1111 1111 4111-1111-1111-1112 +1 (706) 555-3138 +49..-- 12345678-", "é😀 ü.x@y.de é😀 +12 3456 7890", "+" * 500 + "1 2 3 4 5 6 7 8 9 0"]
    texts += ["".join(RNG.choice("a@.%+-0123456789  ()é") for _ in range(RNG.randint(0, 200))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in pii_rules.report(df).collect():
        want = ",".join(brute_spans(texts[r.doc_id] or ""))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest() and r.spans.startswith(want)
    iban = spark.createDataFrame([(1, "iban DE89370400440532013000 and DE89370400440532013001, tel (030) 555 1234, with nothing that speaks for it (030) 555 1234", 1)], "doc_id long, text string, base_spans int")
    assert pii_rules.redacted(iban).first().text == "iban [IBAN] and DE89370400440532013001, tel [TEL], with nothing that speaks for it (030) 555 1234"
    assert pii_rules.redacted(iban).columns == iban.columns


def test_account_numbers_end_by_country(spark):
    texts = {1: "pay DE89370400440532013000 OK", 2: "DE89 3704 0044 0532 0130 00 THANKS", 3: "NO9386011117947", 4: "XX89370400440532013000", 5: "DE8937040044053201300", 6: "IBAN GB82 WEST 1234 5698 7654 32, 10.0.0.1", 7: None}
    rows = {r.doc_id: r for r in pii_rules.report(spark.createDataFrame(list(texts.items()) + [(7, None)], "doc_id long, text string")).collect()}
    assert {i: [x for x in r.spans.split(",") if x.startswith("iban")] for i, r in rows.items()} == {1: ["iban:4:26"], 2: ["iban:0:27"], 3: ["iban:0:15"], 4: [], 5: [], 6: ["iban:5:32"], 7: []}
    assert rows[6].scores == "0.5,1.3" and rows[7].scores == "" and pii_rules.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_secrets(spark):
    runs = {1: 23, 2: 24, 3: 128, 4: 129, 5: 50_000}
    token = {i: ("aB3_" * n)[:n] for i, n in runs.items()}
    df = spark.createDataFrame([(i, f"the token {t}, then") for i, t in token.items()], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii_rules.redacted(df).collect()}
    assert got == {i: f"the token {'[SECRET]' if runs[i] >= 24 else t}, then" for i, t in token.items()}


def test_decontamination(spark, docs, none):
    item = sentence(40)
    w = item.split()
    data = [(1, "before " + item.upper() + " after"), (2, " ".join(w[25:] + ["gap"] + w[:25])), (3, " ".join(w[:10])), (4, None), (5, ""), (6, sentence(40)), (7, "tiny item here"), (None, item), (1, item)]
    bench = spark.createDataFrame([(1, item, 0), (2, None, 0), (3, "", 0), (4, "Tiny, item!", 0)], "item_id long, text string, doc_id int")
    df = spark.createDataFrame([(i, t, 1) for i, t in data], "doc_id long, text string, item_id int")
    got = sorted(((r.doc_id, r.item_id, round(r.coverage, 2), r.n_tiles) for r in tiling_decontamination.leaks(df, bench).collect()), key=repr)
    assert got == sorted([(1, 1, 1.0, 1), (1, 1, 1.0, 1), (2, 1, 1.0, 2), (None, 1, 1.0, 1), (7, 4, 1.0, 1)], key=repr)
    assert tiling_decontamination.leaks(none, bench).count() == 0 and tiling_decontamination.leaks(df, bench.where("false")).count() == 0


def brute_tiles(a, b, least):
    """Words that greedy tiles cover."""
    fa, fb, out = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for j in range(len(b)):
            for i in range(len(a)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and fa[i + k] and fb[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < least:
            return sum(x[0] for x in out)
        k, i, j = best
        out.append(best)
        fa[i : i + k] = fb[j : j + k] = [False] * k


def test_decontamination_in_blocks(spark, monkeypatch):
    """One item a block gives the same rows; a very long text is read to its end."""
    monkeypatch.setattr(tiling_decontamination.blocks, "__defaults__", (tiling_decontamination.LEAST, 10))
    items = [sentence(30) for _ in range(3)]
    df = spark.createDataFrame([(1, sentence(30_000) + " " + items[2]), (2, items[0] + " " + items[1]), (3, sentence(50))], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert len(list(tiling_decontamination.blocks(bench))) == 3
    assert sorted((r.doc_id, r.item_id) for r in tiling_decontamination.leaks(df, bench).collect()) == [(1, 2), (2, 0), (2, 1)]
    assert [r.doc_id for r in tiling_decontamination.clean(df, bench).collect()] == [3]


def test_tiles_are_greedy():
    import numpy as np

    for _ in range(40):
        a, b = [RNG.randrange(4) for _ in range(40)], [RNG.randrange(4) for _ in range(25)]
        got = sum(t[2] for t in tiling_decontamination.tiles(np.array(a, np.uint64) + 7, np.array(b, np.uint64) + 7, 3))
        assert got == brute_tiles(a, b, 3)


def brute_qda(teach, rows, shrink=0.1):
    """Scores by the textbook: class covariances of standardised statistics, solved and not inverted."""
    import numpy as np

    x, y = np.array([s for s, _ in teach]), np.array([c for _, c in teach])
    own = [x[y == c] for c in (0, 1)]
    centre = x.mean(axis=0)
    scale = np.sqrt(np.maximum(sum(len(o) * o.var(axis=0) for o in own) / len(x), 1e-6))
    z = (np.array(rows) - centre) / scale
    log = []
    for o in own:
        o = (o - centre) / scale
        s = (1 - shrink) * np.cov(o.T, bias=True) + (shrink + 1e-9) * np.eye(x.shape[1])
        d = z - o.mean(axis=0)
        log.append(np.log(len(o) / len(x)) - 0.5 * ((d * np.linalg.solve(s, d.T).T).sum(axis=1) + np.linalg.slogdet(s)[1]))
    return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def test_quality_against_brute_force(docs, rows, spark):
    """Repeated rows, null and empty texts and a very long one are scored as the formula says."""
    labels = [(i, int(len(t or "") % 3 > 0), 0) for i, t in rows if i is not None]
    got = quality_qda.classified(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), crc_mod("doc_id", 5) == 0).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0
    y = {i: c for i, c, _ in labels}
    stats = [quality_qda.statistics((t or "").encode()) for _, t in rows]
    want = brute_qda([(s, y[i]) for s, (i, _) in zip(stats, rows, strict=True) if i is not None and not held(i)], stats)
    assert collections.Counter((r.doc_id, r.held_out, round(r.score, 6)) for r in got) == collections.Counter((i, held(i), round(float(s), 6)) for (i, _), s in zip(rows, want, strict=True))


def test_quality(spark, docs, none):
    rng = random.Random(3)
    good = [" ".join(rng.choice(VOCAB) for _ in range(60)) + "." for _ in range(150)]
    bad = [" ".join(rng.choice(VOCAB) + rng.choice(["###", "%%%"]) for _ in range(60)) for _ in range(60)]
    data = [(i, t) for i, t in enumerate(good + bad)] + [(1000, None), (1001, ""), (None, good[0])]
    df = spark.createDataFrame([(i, t, 1.0, "c") for i, t in data], "doc_id long, text string, score double, x string")
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(210)] + [(None, 1, 0), (3, None, 0), (4, 7, 0)], "doc_id long, quality int, toxic int")
    got = quality_qda.classified(df, labels, crc_mod("doc_id", 5) == 0).collect()
    assert len(got) == len(data) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 210]
    assert held and all(r.predicted == int(r.doc_id < 150) for r in held)
    assert quality_qda.classified(none, labels, F.lit(False)).count() == 0
    model = quality_qda.fit(quality_qda.document_statistics(df), labels)
    stay = quality_qda.kept(df, model)
    assert stay.columns == df.columns and {r.doc_id for r in stay.collect() if r.doc_id is not None and r.doc_id < 210} == set(range(150))
    assert quality_qda.fit(quality_qda.document_statistics(df), labels.where("quality = 1")) is None


def test_pieces(spark, docs, rows, none):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sentence_pieces.MODEL)
    texts = [*(t for _, t in rows), " hello  world\n\tx  ", "▁▁x", " " * 100 + "the end" + " " * 37, "naïve 日本語 😀 <s> <0x41>", "ab" * 500 + " " + "the" * 300, "x\x00y\r\n"]
    texts += ["".join(RNG.choice("abcdefghijkethnosr  \n.,AZ09é") for _ in range(RNG.randint(1, 200))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in sentence_pieces.encoded(df).collect()}
    assert got == {i: sp.encode(t or "") for i, t in enumerate(texts)}
    back = sentence_pieces.decoded(sentence_pieces.encoded(df)).collect()
    assert all(r.text == (texts[r.doc_id] or "").replace("▁", " ") for r in back)
    assert {r.doc_id for r in sentence_pieces.round_trips(df).collect() if not r.round_trip} == {i for i, t in enumerate(texts) if "▁" in (t or "")}
    assert sentence_pieces.round_trips(none).count() == 0


def test_unigram_search():
    pieces = ["<unk>", "▁", "a", "b", "▁a", "ab", "▁ab", "ba"]
    model = sentence_pieces.Pieces(pieces, __import__("numpy").array([0, -3, -4, -4, -2.5, -3, -5.9, -3.1]), [2] + [1] * 7, sentence_pieces.UNIGRAM)
    ids = __import__("numpy").frombuffer(model.encode_texts(["ab aba"], {})[0], "<i4")
    assert [pieces[i] for i in ids] == ["▁ab", "▁a", "ba"]
