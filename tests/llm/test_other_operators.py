"""Embeddings, pages and the pipeline."""

import collections
import hashlib
import itertools
import random
import subprocess
import sys
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parchment.llm import permutation_index, quality_qda, queries, sentence_pieces, tiling_decontamination, url_rules, warc_normaliser

from .test_text_operators import VOCAB, brute_qda, brute_spans, brute_tiles, components


def test_nearest(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[100:140] = x[0]
    data = [(i, x[i].tolist(), 1) for i in range(600)]
    data += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [1.0, None] + [0.0] * 14, 1), (904, [1.0, 2.0], 1), (None, x[3].tolist(), 1), (5, x[5].tolist(), 1), (950, [float("inf")] + [1.0] * 15, 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, rank int").repartition(3)
    got = collections.defaultdict(list)
    for r in permutation_index.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    y = x.astype(np.float64)
    n = y / np.sqrt((y * y).sum(axis=1, keepdims=True))
    assert set(got) == set(range(0, 600, 50))
    hits = 0
    for q, found in got.items():
        s = n @ n[q]
        s[q] = -9
        best = np.lexsort((np.arange(600), -s.round(12)))[:5]
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5] and all(abs(f[2] - s[f[1]]) < 1e-9 for f in found)
        hits += len({f[1] for f in found} & set(best.tolist()))
    assert hits >= 0.9 * 60
    assert [f[1] for f in got[0]] == [100, 101, 102, 103, 104] and [f[1] for f in got[100]][:3] == [0, 101, 102]
    assert permutation_index.nearest(df.where("false"), F.lit(True)).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1]), (3, [0.1, 1.0])], "vec_id long, embedding array<double>")
    found = permutation_index.nearest(twice, F.col("vec_id") < 3, top=2).collect()
    assert sorted((r.query_id, r.vec_id) for r in found) == [(1, 2), (1, 3), (2, 1), (2, 3)] and max(r.score for r in found if (r.query_id, r.vec_id) == (2, 1)) > 0.99
    assert permutation_index.nearest(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0).count() == 2


def test_nearest_in_passes(spark):
    """Equal queries are one, passes of any size give the same rows, and queries are not multiplied by chunks in a join, which the driver would have to hold."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8)).round(1)
    data = [(i, x[i % 60 if i % 3 else i].tolist()) for i in range(300)] + [(10, x[7].tolist()), (20, x[7].tolist()), (30, x[8].tolist())]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)
    one = permutation_index.nearest(df, F.col("vec_id") % 5 == 0, share=1.0)
    assert "explode" not in one._jdf.queryExecution().toString()
    want = []
    for q in range(0, 300, 5):
        scores = {}
        for i, v in data:
            for w in (np.array(w) for j, w in data if j == q):
                if i != q:
                    scores[i] = max(scores.get(i, -2), permutation_index.cosines(w, np.array([v]))[0])
        want += [(q, k + 1, i, scores[i]) for k, i in enumerate(sorted(scores, key=lambda i: (-scores[i], i))[:5])]
    assert sorted(map(tuple, one.collect())) == want
    many = permutation_index.nearest(df, F.col("vec_id") % 5 == 0, share=1.0, pass_bytes=600)
    assert sorted(map(tuple, many.collect())) == want


def test_warc(spark, tmp_path):
    h = ["x" * 200, "é" * 80, "\r\n\r\nWARC/1.1\r\n" * 30]
    data = [(1, "http://a", h[0], 0), (2, None, h[0], 0), (0, "http://b\r\nq", h[0], 0), (None, "u", h[0], 0), (3, "u", None, 0), (4, "u", "short", 0), (5, "u", "short", 0), (6, "u", h[1], 0), (6, "u", h[1], 0), (7, "", h[2], 0)]
    df = spark.createDataFrame(data, "page_id long, url string, html string, digest int").repartition(2)
    got = collections.Counter(tuple(r) for r in warc_normaliser.round_trip(df).collect())
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    n = lambda t: len((t or "").encode())
    want = collections.Counter([(i, n(t), sha(t), "revisit" if i in (1, 2, None) else "response", 0 if i in (1, 2, None) else None) for i, _, t, _ in data])
    want[(6, 160, sha(h[1]), "response", None)] -= 1
    want[(6, 160, sha(h[1]), "revisit", 6)] += 1
    assert got == want
    assert warc_normaliser.round_trip(df.where("false")).count() == 0
    archives = warc_normaliser.write_archives(df, f"file://{tmp_path}/w")
    rows = warc_normaliser.read_archives(spark, f"file://{tmp_path}/w", archives, payloads=True).collect()
    assert {r.page_id: r.payload.decode() for r in rows if r.record_type == "response"} == {0: h[0], 3: "", 4: "short", 5: "short", 6: h[1], 7: h[2]}
    assert not [p for p in Path(tmp_path, "w").iterdir() if p.suffix == ".part" or p.name.endswith("0.warc.gz")]


def test_warc_rolls_over(spark, tmp_path):
    h = ["page " * 400 + str(i % 7) for i in range(40)]
    df = spark.createDataFrame(list(enumerate(h)), "page_id long, html string").selectExpr("page_id", "'u' as url", "html").coalesce(1)
    archives = warc_normaliser.write_archives(df, f"file://{tmp_path}/w", archive_bytes=10_000)
    assert archives.count() == 10
    rows = {r.page_id: r for r in warc_normaliser.read_archives(spark, f"file://{tmp_path}/w", archives, payloads=True).collect()}
    assert all(rows[i].payload.decode() == h[i] if i < 7 else rows[i].refers_to == i % 7 for i in range(40))


def test_warc_lines_and_null_ids(spark, tmp_path):
    h = "y" * 150
    urls = ["http://a/\u0085b", "http://a/\u2028b", "http://a/\u2029b"]
    data = [*((i, u, f"page {i}") for i, u in enumerate(urls)), (None, "u", h), (None, "v", h)]
    df = spark.createDataFrame(data, "page_id long, url string, html string").coalesce(1)
    archives = warc_normaliser.write_archives(df, f"file://{tmp_path}/w")
    rows = warc_normaliser.read_archives(spark, f"file://{tmp_path}/w", archives).collect()
    assert sorted(r.uri for r in rows if r.page_id is not None) == sorted(urls)
    assert sorted((r.record_type, r.refers_to, r.payload_bytes) for r in rows if r.page_id is None) == [("response", None, 150), ("revisit", None, 150)]


def test_normaliser_streams():
    body = bytes(random.Random(1).randrange(256) for _ in range(5000))
    plain = b"".join(warc_normaliser.record({"WARC-Type": "response", "WARC-Record-ID": f"<{i}>"}, body[:n]) for i, n in enumerate((0, 10, 5000)))
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    stream = pack.compress(plain) + pack.flush()
    for size in (7, 1000, 10**6):
        got = list(warc_normaliser.normalised(iter([stream[i : i + size] for i in range(0, len(stream), size)])))
        assert b"".join(zlib.decompress(m, 31) for m, _ in got) == plain and len(got) == 3


def brute_rules(labelled, support, confidence):
    n = len(labelled)
    tokens = sorted({t for items, _ in labelled for t in items})
    out = {}
    for k in range(1, 5):
        for some in itertools.combinations(tokens, k):
            have = [v for items, v in labelled if set(some) <= set(items)]
            for verdict in set(have):
                both = have.count(verdict)
                if both >= support * n and both >= confidence * len(have):
                    out[(some, verdict)] = both / len(have)
    return out


def test_url_rules(spark):
    rng = random.Random(2)
    labelled = [([t for t in ("a", "b", "c", "d") if rng.random() < 0.6], rng.choice(["allow", "block", "block"])) for _ in range(80)]
    labelled = [(i, v) for i, v in labelled if i]
    index, classes = url_rules.mined(spark.createDataFrame([(f"u{k}", i, v) for k, (i, v) in enumerate(labelled)], "id string, items array<string>, verdict string"), 0.05, 0.6)
    got = {(tuple(r.tokens), r.verdict): r.confidence for r in index.collect()}
    want = brute_rules(labelled, 0.05, 0.6)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    urls = spark.createDataFrame([("u1", ["a", "b"]), ("u2", ["z"]), ("u3", [])], "url string, items array<string>")
    fit = max(((c, len(k), k, v) for (k, v), c in want.items() if set(k) <= {"a", "b"}), default=None)
    found = {r.url: r.found for r in url_rules.matched(urls, index, classes).collect()}
    assert set(found) == ({"u1"} if fit else set())


def test_url_rules_of_long_paths(spark):
    """Forty tokens that always come together are one item, and each of them stands for it; equal urls teach once."""
    path = "/".join(f"part{i}" for i in range(40))
    urls = [f"http://shop.net/es/{path}/{i % 30}" for i in range(60)] + [f"http://news.com/{path.replace('part', 'item')}/{i}/end{i}" for i in range(30)]
    urls += ["http://other.org/part7", "http://other.org/nothing", "http://other.org/" + "a/" * 3000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_rules.judged(df).collect()}
    assert all(got[i].rule == "net/es/" and got[i].verdict == "block" for i in range(60)) and all(got[i].verdict == "allow" for i in range(60, 90))
    assert got[90].verdict == "block" and got[90].mined and not got[91].mined and got[92].verdict == "allow"


def test_url_parts_and_stated_rules(spark):
    cases = [("http://WWW.Example.com/en/a?x#y", "www.example.com", "/en/a", "www.example.com/en/", "allow"), ("https://m.example.com/en/1", "m.example.com", "/en/1", "example.com/en/", "block"), ("ftp://x.com/", "x.com", "/", "com/", "allow"), ("http://x.com", "x.com", "", None, "allow"), ("http://a.net/es/?q", "a.net", "/es/", "net/es/", "block"), ("net/es/", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("://net/fr/x#?", "net", "/fr/x", "net/fr/", "block"), ("http://h?a/b", "h", "", None, "allow"), ("x://y://z/p", "y:", "//z/p", None, "allow")]
    df = spark.createDataFrame([(i, c[0], "k") for i, c in enumerate(cases)], "page_id long, url string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule) for r in url_rules.judged(df).collect()}
    assert got == {i: c[1:4] for i, c in enumerate(cases)}
    stated = {r.page_id: r.verdict for r in url_rules.judged(df).collect() if r.rule}
    assert stated == {i: c[4] for i, c in enumerate(cases) if c[3]}
    assert url_rules.judged(df.where("false")).count() == 0


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert 0.5 * docs.count() < len(out) < docs.count() and all(r.round_trip and r.n_tokens == len(r.ids) for r in out)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_qda", "minhash_dedup", "tiling_decontamination", "pii_rules", "sentence_pieces"]


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sentence_pieces.MODEL)
    rng = random.Random(8)
    text = lambda n, tail="": " ".join(rng.choice(VOCAB) for _ in range(n)) + "." + tail
    items = [text(30) for _ in range(3)]
    good = [text(rng.randint(30, 60)) for _ in range(30)]
    near = [" ".join([*g.split()[:4], "changed", *g.split()[5:]]) for g in good[:8]]
    leaks = ["lead in " + items[0] + " and out", " ".join(items[1].split()[15:] + ["gap"] + items[1].split()[:15]), "only " + " ".join(items[2].split()[:10])]
    private = [text(30, f" mail a{i}@example.org or call +49 30 {i}234567 from 10.0.0.{i}") for i in range(4)]
    bad = [" ".join(rng.choice(VOCAB) + rng.choice(["###", "%%%", "|||"]) for _ in range(rng.randint(20, 50))) for _ in range(25)]
    texts = [*good, *near, good[0], *leaks, *private, *bad, "", None]
    data = [(7 * i % 101, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(None, good[1], "en", "s", 1), (None, leaks[0], "en", "s", 1)]
    marks = {t: 0 if t in bad else 1 for t in texts if t}
    labels = [(i, marks[t], 0) for i, t, *_ in data if i is not None and t]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    # quality
    stats = [quality_qda.statistics((t or "").encode()) for _, t, *_ in data]
    teach = [(s, marks[t]) for s, (i, t, *_) in zip(stats, data, strict=True) if i is not None and t]
    left = [d for d, s in zip(data, brute_qda(teach, stats), strict=True) if s >= 0.3]
    assert 20 < len(data) - len(left) < 35
    # near copies
    least = {i: c for i, (_, c) in components([(i, t) for i, t, *_ in left if i is not None], 5, 80).items()}
    left = [d for d in left if d[0] is None or least[d[0]] == d[0]]
    # benchmark
    fold = tiling_decontamination.words_of
    left = [d for d in left if not any(brute_tiles(fold((d[1] or "").encode()), fold(x.encode()), 5) >= 0.5 * len(fold(x.encode())) for x in items)]
    # personal data, then pieces
    want = collections.Counter()
    for i, t, lang, source, _ in left:
        t = t or ""
        spans = sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in brute_spans(t)))
        for a, b, k in reversed(spans):
            t = t[:a] + f"[{k.upper()}]" + t[b:]
        want[(i, lang, source, tuple(sp.encode(t)), len(sp.encode(t)), True)] += 1
    got = collections.Counter((r.doc_id, r.lang, r.source, tuple(r.ids), r.n_tokens, r.round_trip) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want and 30 < len(want) < 50


def test_pipeline_leaks_under_null_ids(spark, tmp_path):
    item = " ".join(f"word{i}" for i in range(40))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    data = [(None, f"before {item} after"), (None, "a clean text without an id"), (1, item), (1, "the same id with a clean text"), (2, None), (3, "clean")]
    df = spark.createDataFrame([(i, "en", t) for i, t in data], "doc_id long, lang string, text string")
    left = corpus_pipeline.decontaminate(spark, df, str(tmp_path))
    assert left.columns == df.columns
    assert collections.Counter((r.doc_id, r.text) for r in left.collect()) == collections.Counter(x for x in data if item not in (x[1] or ""))


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.queries() if n.startswith("op")] == [f"op{i}" for i in range(1, 11)]
    assert set(queries.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    kinds = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    got = queries.queries()[name](spark, sf_dir)
    if name.startswith("op"):
        got = got.select(want.columns)
    assert {n: kinds[t] for n, t in got.dtypes} == dict(zip(want.columns, map(str, want.types), strict=True))
    key = lambda r: repr(tuple(r))
    assert sorted(map(tuple, got.select(want.columns).collect()), key=key) == sorted(want.fetchall(), key=key)


def test_engine_stands_without_this_folder(tmp_path):
    code = "import sys; sys.modules['parchment.llm'] = None; sys.path.insert(0, sys.argv[1]); import __spark_entry__ as e; assert 'pdf_text' in e.queries() and not any(k.startswith(('op1_', 'op2_', 'pipeline')) for k in e.queries())"
    subprocess.run([sys.executable, "-c", code, str(Path(__file__).resolve().parents[2])], check=True)
