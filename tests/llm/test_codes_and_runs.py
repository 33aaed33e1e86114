"""Periodic runs, vector codes and token files against brute-force versions."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from branchdata.llm import periodic, queries, rans, tokenfiles, veccodes, wordbatch
from branchdata.llm.common import scratch
from tests.llm.helpers import CLASHING, SF001, both, edge_docs, empty, given, rows_of

pytestmark = pytest.mark.filterwarnings("ignore")


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


# -- periodic runs ---------------------------------------------------------
def brute_runs(words: list) -> list[tuple[int, int, int]]:
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(6, 4 * q):
                found.setdefault((s, i + q - s), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def random_words(rng: random.Random) -> list[int]:
    n, letters = rng.choice([0, 1, 5, 6, 7, 30, 200, 500]), rng.choice([1, 2, 3, 40])
    words = [rng.randrange(letters) for _ in range(n)]
    if n > 20 and rng.random() < .7:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(3, 10)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_shift_table():
    inside = [x in periodic.COVER for x in range(periodic.MOD)]
    for a in range(periodic.MOD):
        for b in range(periodic.MOD):
            h = int(periodic.SHIFT[a, b])
            assert inside[(a + h) % periodic.MOD] and inside[(b + h) % periodic.MOD]


def test_extensions():
    rng = random.Random(2)
    for _ in range(40):
        words = [rng.randrange(2) for _ in range(rng.choice([1, 40, 300]))]
        if rng.random() < .5:
            words = (words[:rng.randint(1, 40)] * 300)[:300]
        words.append(99)
        extend = periodic.Extensions(np.array(words))
        pairs = sorted({tuple(sorted(rng.sample(range(len(words)), 2))) for _ in range(200)})
        want = []
        for a, b in pairs:
            k = 0
            while b + k < len(words) and words[a + k] == words[b + k]:
                k += 1
            want.append(k)
        assert extend(*np.array(pairs, np.int64).T).tolist() == want


@pytest.mark.parametrize("pairs,group", [(1 << 20, 1 << 17), (37, 900), (3, 10)])
def test_runs(monkeypatch, pairs, group):
    monkeypatch.setattr(periodic, "PAIRS", pairs)
    monkeypatch.setattr(periodic, "GROUP", group)
    rng = random.Random(pairs)
    for _ in range(25 if pairs > 3 else 3):
        texts = [random_words(rng) for _ in range(rng.randint(1, 20))]
        texts += texts[:2]
        bounds = np.concatenate([[0], np.cumsum([len(w) for w in texts])])
        got = defaultdict(list)
        for text, *run in zip(*(x.tolist() for x in periodic.batch_runs(bounds, np.array(sum(texts, []), np.int64)))):
            got[text].append(tuple(run))
        assert [got[i] for i in range(len(texts))] == [brute_runs(w) for w in texts]


def brute_collapsed(words: list[bytes], runs) -> str:
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone).decode()


def test_op11(spark, tmp_path):
    texts = ["a " * 40, "x y " * 3 + "z", "x y " * 4 + "x", " \v\f\x1c b b " * 9, "ja nein\n" * 500, "q"]
    extra = spark.createDataFrame([(2000000 + i, texts[i % len(texts)]) for i in range(120)], "doc_id long, text string")
    docs = both(spark).unionByName(extra, allowMissingColumns=True)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for doc, text in docs.select("doc_id", "text").collect():
        words = (text or "").encode().split()
        n, h = len(words), zlib.crc32(str(doc).encode()) if doc is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words) if n <= 3000 else None
        want.append((doc, n, words, runs))
    got = defaultdict(list)
    for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect():
        got[r["doc_id"]].append(tuple(r)[1:])
    expected = defaultdict(list)
    for doc, n, words, runs in want:
        if runs is None:
            runs = [tuple(x) for x in zip(*(v.tolist() for v in periodic.batch_runs(
                np.array([0, n]), np.unique(words, return_inverse=True)[1])[1:]))]
        top = min(((-k, s, q) for s, k, q in runs), default=None)
        best = (None,) * 4 if top is None else (top[1], -top[0], top[2], 1000 * -top[0] // top[2])
        expected[doc].append((len(runs), *best, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)),
                              sha(brute_collapsed(words, runs))))
    assert {d: sorted(map(repr, v)) for d, v in got.items()} == {d: sorted(map(repr, v)) for d, v in expected.items()}
    assert sum(v[0][0] > 0 for v in expected.values()) > 60


def test_periodic_edges(spark):
    got = periodic.periodic_runs(edge_docs(spark))
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    assert got.count() == edge_docs(spark).count() and periodic.periodic_runs(empty(spark)).collect() == []
    r = periodic.periodic_runs(spark.createDataFrame([(1, "a b " * 4)], "doc_id long, text string")).first()
    assert [tuple(x) for x in r["runs"]] == [(0, 8, 2)] and r["collapsed"] == "a b"


# -- vector codes -----------------------------------------------------------
def test_hilbert_neighbours():
    for m, side in ((2, 16), (3, 8)):
        points = np.stack(np.meshgrid(*[np.arange(side)] * m, indexing="ij"), -1).reshape(-1, m)
        walk = points[np.argsort(veccodes.hilbert_keys(points))]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def brute_codes(rows, parts=16, entries=64, rounds=2):
    """rows: (vec_id, label, vector) of usable vectors."""
    whole = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows]
    m = len(whole[0][2]) // parts
    cut = [[tuple(v[p * m:(p + 1) * m]) for p in range(parts)] for _, _, v in whole]
    order = sorted(range(len(whole)), key=lambda i: (whole[i][0] is None, whole[i][0] or 0, rows[i][2]))
    books = [[cut[i][p] for i in order[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            held = defaultdict(list)
            for v in cut:
                held[nearest(p, v[p])[1]].append(v[p])
            new.append([tuple(sum(c) // len(held[k]) for c in zip(*held[k])) if k in held else e
                        for k, e in enumerate(books[p])])
        books = new
    out = []
    for (i, label, _), v in zip(whole, cut):
        near = [nearest(p, v[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in near), sum(d for d, _ in near)))
    totals = Counter()
    for _, label, _, e in out:
        totals[label] += e
    flat = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, code, e, totals[label], flat) for i, label, code, e in out), key=repr)


def usable(rows):
    return [r for r in rows if r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]


@pytest.mark.parametrize("n,width", [(0, 16), (1, 16), (40, 16), (700, 32)])
def test_vector_codes(spark, tmp_path, monkeypatch, n, width):
    rng = random.Random(n)
    rows = [(rng.randrange(max(n, 1)), rng.choice([None, 1, 2]), [rng.gauss(0, .3) for _ in range(width)]) for _ in range(n)]
    rows += [(5, 1, r[2]) for r in rows[:1] for _ in range(n // 3)] + [(None, 2, [9.0] * width), (None, 2, [9.0] * width)] * (n > 0)
    rows += [(-1, 1, None), (-2, 1, [None] + [0.0] * (width - 1)), (-3, None, [float("nan")] * width),
             (-4, 2, [float("inf")] + [1.0] * (width - 1)), (-5, 2, [float("-inf")] * width)]
    schema = "vec_id long, label int, embedding array<float>, " + ", ".join(f"{c} int" for c in (*CLASHING, "part", "code"))
    df = spark.createDataFrame([(*r, *range(len(CLASHING) + 2)) for r in rows], schema).repartition(3)
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    fine = usable([(r[0], r[1], r[2]) for r in df.select("vec_id", "label", "embedding").collect()])
    got = queries.op12_vector_codes(spark, str(tmp_path))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert rows_of(got) == (brute_codes(fine) if fine else [])


def test_shortlists_leave_out():
    """On clustered data most blocks need few entries, and none is lost."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-2000, 2000, (64, 4))
    points = (centres[rng.integers(0, 64, 20000)] + rng.integers(-20, 20, (20000, 4))).astype(np.int32)
    chunk = veccodes.Chunk.build(np.tile(points, (1, 16)), 16)
    books = np.repeat(centres[None], 16, 0).astype(np.int64)
    assert chunk.shortlists(0, books[0]).mean() < .2
    codes, error = chunk.codes(books)
    apart = ((points[:, None].astype(np.int64) - centres) ** 2).sum(-1)
    assert (codes == apart.argmin(1)[:, None]).all() and (error == 16 * apart.min(1)).all()


def test_vector_codes_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF001}/embeddings.parquet'")
    want = con.execute(queries.oracle_sql()["op12_vector_codes"]).fetchall()
    assert sorted(map(tuple, want), key=repr) == rows_of(queries.op12_vector_codes(spark, SF001))


def test_vector_codes_reject(spark):
    far = spark.createDataFrame([(1, 1, [1e30] * 16)], "vec_id long, label int, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        veccodes.compress(far)
    odd = spark.createDataFrame([(1, 1, [1.0] * 15)], "vec_id long, label int, embedding array<double>")
    with pytest.raises(ValueError, match="equal parts"):
        veccodes.compress(odd)


# -- token files --------------------------------------------------------------
@pytest.mark.parametrize("n,kinds,lanes,every", [(0, 1, 8, 2), (1, 1, 2048, 128), (129, 5, 2048, 128), (5000, 300, 7, 3),
                                                 (70000, 40000, 64, 5), (300000, 50, 512, 100)])
def test_rans(n, kinds, lanes, every):
    rng = np.random.default_rng(n)
    ids = (rng.pareto(.8, n) * 3).astype(np.int64) % kinds
    symbols, counts = np.unique(np.append(ids, 0), return_counts=True)
    table = rans.Table.fit(symbols.tolist(), counts.tolist())
    frame = rans.encode(table, ids, [n], lanes, every)
    back, lengths = rans.decode(table, frame)
    assert back.tolist() == ids.tolist() and lengths.tolist() == [n]
    for at in range(0, len(frame), max(1, len(frame) // 25)):
        bad = bytearray(frame)
        bad[at] ^= 16
        with pytest.raises(rans.DamagedBlock):
            rans.decode(table, bytes(bad))
    with pytest.raises(rans.DamagedBlock):
        rans.decode(rans.Table.fit([0, 7], [3, 5]), frame)


def test_rans_size():
    ids = np.random.default_rng(5).choice(2000, 1 << 20, p=np.arange(2000, 0, -1) / 2001000)
    symbols, counts = np.unique(ids, return_counts=True)
    p = counts / counts.sum()
    frame = rans.encode(rans.Table.fit(symbols.tolist(), counts.tolist()), ids, [len(ids)])
    assert len(frame) < 1.1 * -(p * np.log2(p)).sum() * len(ids) / 8


def test_batch_ids_equal_the_library():
    from tokenizers import Tokenizer
    path = queries.tokenizer_path(queries.WORD_TOKENIZER)
    rng = random.Random(1)
    bits = ["a", "B", "é", "ß", " ", "\n", "\t", "\v", "\f", "\x1c", "1", ".", ",", "'s", "'", "<|", "|>", "<|endoftext|>",
            "İ", "日", "\xa0", "\x85", "ﬁ", "'ll", "-", "€"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(5000)] + [None]
    bounds, ids = wordbatch.BatchIds(path, kept=50).batch(pa.array(texts))
    library = Tokenizer.from_file(path)
    for i, t in enumerate(texts):
        assert ids[bounds[i]:bounds[i + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids


def test_other_tokenizers_go_to_the_library():
    """Words and stops are cut only for the file that they stand for."""
    from tokenizers import Tokenizer
    from branchdata.llm import tokencount
    texts = ["One, two.  three\n\nfour's", "", "a b", "x\ty."]
    word, byte = (queries.tokenizer_path(f) for f in (queries.WORD_TOKENIZER, queries.BYTE_TOKENIZER))
    assert wordbatch.BatchIds(word).by_words and tokencount.Counter(byte).known
    library = Tokenizer.from_file(byte)
    bounds, ids = wordbatch.BatchIds(byte).batch(pa.array(texts))
    assert [ids[a:z].tolist() for a, z in zip(bounds, bounds[1:])] == [library.encode(t).ids for t in texts]
    other = Tokenizer.from_file(word)
    assert tokencount.Counter(word).batch(pa.array(texts)).tolist() == [len(other.encode(t).ids) for t in texts]


@pytest.mark.parametrize("block", [1 << 20, 1000, 64])
def test_token_files(spark, block):
    from tokenizers import Tokenizer
    path = queries.tokenizer_path(queries.WORD_TOKENIZER)
    library = Tokenizer.from_file(path)
    docs = both(spark) if block > 64 else edge_docs(spark, extra=False).where("doc_id is null or doc_id <> 10")
    docs = docs.repartition(5)
    want = [(doc, [*library.encode(text or "", add_special_tokens=False).ids, 1])
            for doc, text in docs.select("doc_id", "text").collect()]
    to = scratch(spark, "test-token-files")
    tokenfiles.write(docs, path, to, block=block)
    got = tokenfiles.documents(tokenfiles.read(spark, to)).orderBy("start").collect()
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    assert [r["doc_id"] is not None for r in got] == sorted(r["doc_id"] is not None for r in got)
    ids = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert ids == sorted(ids)
    assert (Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got)
            == Counter((d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in want))
    whole = defaultdict(list)
    for r in tokenfiles.read(spark, to, with_ids=True).orderBy("start", "at").collect():
        assert len(whole[r["start"]]) == r["at"] and r["length"] == len(r["ids"])
        whole[r["start"]] += r["ids"]
    assert Counter(map(tuple, whole.values())) == Counter(tuple(i) for _, i in want)


def test_token_files_empty_and_damaged(spark, tmp_path):
    path = queries.tokenizer_path(queries.WORD_TOKENIZER)
    tokenfiles.write(empty(spark), path, str(tmp_path / "none"))
    assert tokenfiles.read(spark, str(tmp_path / "none")).collect() == []
    tokenfiles.write(given(spark, "documents"), path, str(tmp_path / "some"))
    blocks = spark.read.parquet(str(tmp_path / "some" / "blocks"))
    from pyspark.sql import functions as F
    broken = F.expr("concat(substring(frame, 1, 200), unhex('00'), substring(frame, 202))")
    blocks.withColumn("frame", broken).write.parquet(str(tmp_path / "bad" / "blocks"))
    for x in ("table", "parts"):
        spark.read.parquet(str(tmp_path / "some" / x)).write.parquet(str(tmp_path / "bad" / x))
    with pytest.raises(Exception, match="DamagedBlock"):
        tokenfiles.read(spark, str(tmp_path / "bad")).collect()
    assert tokenfiles.read(spark, str(tmp_path / "some")).where("ends").count() == given(spark, "documents").count()
