"""Operators on documents against brute-force versions."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from branchdata.llm import decontam, langid, linededup, packing, pii, queries, simhash, tokencount
from branchdata.llm.pii import KINDS
from tests.llm.helpers import both, edge_docs, edge_rows, empty, given, rows_of

pytestmark = pytest.mark.filterwarnings("ignore")


@pytest.fixture(scope="module")
def docs(spark):
    return both(spark).cache()


@pytest.fixture(scope="module")
def plain(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


# -- packing ------------------------------------------------------------
def test_cuts():
    for n in [*range(1, 300), 4095, 4096, 4097, 8191, 3 * 4096 + 5]:
        c = packing.cuts(n)
        assert sum(c) == n and c == sorted(c, reverse=True) and all(x & (x - 1) == 0 for x in c)
        assert all(x == 4096 or c.count(x) == 1 for x in c)


def test_packing_round_trip(spark, docs, plain):
    from tokenizers import Tokenizer
    path = queries.tokenizer_path(queries.WORD_TOKENIZER)
    tokenizer = Tokenizer.from_file(path)
    got = packing.pack(docs, path).collect()
    want = Counter()
    for doc, text in plain:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        at = 0
        for n in packing.cuts(len(ids)):
            part = ids[at:at + n]
            want[doc, at, n, zlib.crc32(np.array(part, "<u4").tobytes()), len(ids), tuple(part)] += 1
            at += n
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"], tuple(r["ids"])) for r in got) == want
    assert len({r["sequence_id"] for r in got}) == len(got) and {r["offset"] for r in got} == {0}
    assert rows_of(packing.pack(empty(spark), path)) == []
    assert packing.pack(edge_docs(spark), path).count() == packing.pack(edge_docs(spark, extra=False), path).count()


def test_buckets(spark, tmp_path):
    path = queries.tokenizer_path(queries.WORD_TOKENIZER)
    packing.write_buckets(packing.pack(given(spark, "documents"), path), str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.where("size(ids) <> bucket").count() == 0 and back.count() > 200


# -- token counts --------------------------------------------------------
@pytest.mark.parametrize("chunk,overlap", [(1 << 16, 512), (300, 80)])
def test_token_counts(spark, docs, plain, chunk, overlap):
    from tokenizers import Tokenizer
    path = queries.tokenizer_path(queries.BYTE_TOKENIZER)
    tokenizer = Tokenizer.from_file(path)
    got = rows_of(tokencount.token_counts(docs, path, chunk=chunk, overlap=overlap))
    want = []
    for doc, text in plain:
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        want.append((doc, len((text or "").encode()), n, n > 512))
    assert got == sorted(want, key=repr)
    assert rows_of(tokencount.token_counts(empty(spark), path)) == []


# -- decontamination -----------------------------------------------------
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(plain, items, window=10):
    wins = defaultdict(set)
    for item, text in items:
        w = words(text)
        if item is not None and w:
            for i in range(max(1, len(w) - window + 1)):
                wins[tuple(w[i:i + window])].add(str(item))
    out = []
    for doc, text in plain:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in wins}:
            for i in range(len(w) - size + 1):
                if tuple(w[i:i + size]) in wins:
                    hit.update(range(i, i + size))
                    found |= wins[tuple(w[i:i + size])]
        out.append((doc, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=repr)


ITEMS = [(7, " ".join(f"Word{i}" for i in range(5, 40))), (7, "alpha beta gamma"), (70, "one TWO three"), (None, "a"),
         (8, None), (9, "..."), (10, "word3 word4"), (11, "für 1234")]


@pytest.mark.parametrize("item_bytes,block_words", [(1 << 24, 1 << 20), (60, 500)])
def test_decontamination(spark, docs, plain, item_bytes, block_words):
    bench = given(spark, "benchmark").select("item_id", "text")
    items = [(r["item_id"] + 100, r["text"]) for r in bench.collect()][:12] + ITEMS
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.decontaminate(docs, tests, item_bytes=item_bytes, block_words=block_words).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_ids"])) for r in got), key=repr) == \
        brute_hits(plain, items)
    assert all(r["n_items"] == len(r["item_ids"]) and r["contaminated"] == (r["n_hit"] > 0)
               and set(r["item_ids"]) <= set(r["near_ids"]) for r in got)


def test_decontamination_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in given(spark, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in given(spark, "benchmark").collect()]
    got = decontam.decontaminate(given(spark, "documents"), given(spark, "benchmark")).collect()
    want = brute_hits(rows, items)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_ids"])) for r in got), key=repr) == want
    assert any(w[2] for w in want)


def test_proximity_and_empty(spark):
    one = spark.createDataFrame([(1, "k0 x k1 k2 y k3 k4"), (2, "k4 k3"), (3, "k0 k1 k2 k3 k4")], "doc_id long, text string")
    tests = spark.createDataFrame([(5, "k0 k1 k2 k3 k4")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["near_ids"]) for r in decontam.decontaminate(one, tests).collect()}
    assert got == {1: (0, ["5"]), 2: (0, []), 3: (5, ["5"])}
    assert rows_of(decontam.decontaminate(empty(spark), tests)) == []
    none = decontam.decontaminate(edge_docs(spark), tests.limit(0)).collect()
    assert len(none) == len(edge_rows()) and not any(r["contaminated"] for r in none)


# -- line dedup ----------------------------------------------------------
def brute_lines(plain):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\v\f\r"))

    holders = defaultdict(set)
    for doc, text in plain:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(doc)
    out = []
    for doc, text in plain:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            h = holders.get(key(line), ())
            ids = [x for x in h if x is not None]
            if len(h) < 3 or doc == max(ids):
                kept.append(line)
        out.append((doc, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=repr)


def test_line_dedup(spark, docs, plain):
    got = linededup.line_dedup(docs).select("row.doc_id", "n_lines", "n_dropped", "kept").collect()
    assert sorted(((r[0], r[1], r[2], sha(r[3])) for r in got), key=repr) == brute_lines(plain)
    extra = edge_docs(spark)
    full = linededup.line_dedup(extra)
    assert full.select("row.*").schema == extra.schema
    got = full.select("row.doc_id", "n_lines", "n_dropped", "kept").collect()
    assert sorted(((r[0], r[1], r[2], sha(r[3])) for r in got), key=repr) == brute_lines(edge_rows())
    assert rows_of(linededup.line_dedup(empty(spark))) == []


# -- SimHash -------------------------------------------------------------
def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    distinct = sorted(set(fps))
    parent = {f: f for f in distinct}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 4:
                parent[find(a)] = find(b)
    return {f: find(f) for f in distinct}


def test_fingerprints_match_spark_hash(spark):
    from pyspark.sql import functions as F
    for s in ("", "a b c d", "für alle fälle"):
        want = spark.range(1).select(F.xxhash64(F.lit(s))).first()[0]
        assert np.uint64(xxhash.xxh64_intdigest(s, seed=42)).view(np.int64) == want


def test_simhash(spark, docs, plain, monkeypatch):
    monkeypatch.setattr(simhash, "SLICE", 200)
    texts = {t for _, t in plain}
    fps = {t: brute_fingerprint(t) for t in texts}
    assert all(simhash.fingerprint(t) == f for t, f in fps.items())
    root = brute_components(list(fps.values()))
    least = {}
    for doc, t in plain:
        if doc is not None:
            least[root[fps[t]]] = min(doc, least.get(root[fps[t]], doc))
    want = sorted(((d, f"{fps[t]:016x}", least.get(root[fps[t]])) for d, t in plain), key=repr)
    assert rows_of(simhash.near_duplicates(docs)) == want
    assert rows_of(simhash.near_duplicates(empty(spark))) == []


def test_bk_tree_groups_against_all_pairs():
    rng = np.random.default_rng(2)
    centre = int(rng.integers(0, 1 << 63))
    near = {centre}
    for _ in range(300):
        f = list(near)[int(rng.integers(len(near)))]
        for b in rng.integers(0, 64, int(rng.integers(1, 7))):
            f ^= 1 << int(b)
        near.add(f)
    fps = sorted(near | {int(x) for x in rng.integers(0, 1 << 63, 200)})
    root = brute_components(fps)
    seen = {f: f for f in fps}
    for f, first in simhash.groups(fps, 4):
        seen[f] = first
    assert len(set(seen.values())) == len(set(root.values()))
    assert {tuple(sorted(f for f in fps if seen[f] == g)) for g in set(seen.values())} == \
        {tuple(sorted(f for f in fps if root[f] == g)) for g in set(root.values())}


@pytest.mark.parametrize("shard_size", [simhash.SHARD_SIZE, 16])
def test_links_over_shards(spark, shard_size):
    """Also where clusters overfill shards, which are cut again."""
    rng = np.random.default_rng(3)
    fps = {int(x) for x in rng.integers(0, 1 << 64, 400, dtype=np.uint64)}
    for f in list(fps)[:200]:
        for _ in range(3):
            g = f
            for b in rng.choice(64, int(rng.integers(1, 7)), replace=False):
                g ^= 1 << int(b)
            fps.add(g)
    centre = min(fps)
    for _ in range(60):        # shards of many
        fps.add(centre ^ int(rng.integers(0, 1 << 20)))
    root = brute_components(list(fps))
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    got = {np.int64(r["node"]).view(np.uint64): r["label"] for r in simhash.labels(simhash.links(df, shard_size=shard_size)).collect()}
    assert set(got) == {f for f in fps if sum(root[g] == root[f] for g in fps) > 1}
    by_label, by_root = defaultdict(set), defaultdict(set)
    for f, label in got.items():
        by_label[label].add(int(f))
        by_root[root[int(f)]].add(int(f))
    assert sorted(map(sorted, by_label.values())) == sorted(map(sorted, by_root.values()))


# -- personal data -------------------------------------------------------
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute_pii(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, (text or "") if kind != "email" or "@" in (text or "") else ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                    or kind == "card" and 16 <= len(digits) <= 19 and luhn(digits)
                    or kind == "phone" and 8 <= len(digits) <= 15):
                out.append((kind, m.start(), m.end()))
    return out


def test_pii(spark, docs, plain):
    got = pii.find_pii(docs).collect()
    as_base = sorted(((r["doc_id"], [(KINDS[k], s, e) for k, s, e in r["base"]]) for r in got), key=repr)
    assert as_base == sorted(((d, brute_pii(t)) for d, t in plain), key=repr)
    spans = {r["doc_id"]: [(KINDS[k], s, e) for k, s, e in r["spans"]] for r in got}
    assert all(set(map(tuple, r["base"])) <= set(map(tuple, r["spans"])) for r in got)
    added = [x for x in spans[24] if x not in brute_pii(dict(edge_rows())[24])]
    assert {k for k, _, _ in added} == {"email", "card", "phone"}
    assert rows_of(pii.find_pii(empty(spark))) == []


def test_pii_query_has_no_python(spark):
    from tests.llm.helpers import SF001
    found = queries.op4_pii_votes(spark, SF001)
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    row = next(r for r in found.collect() if r["n_email"])
    assert row["spans"].startswith("email:")


def test_estimate_finds_the_liar():
    """Votes drawn with known reliabilities: the estimate comes near them."""
    rng = np.random.default_rng(0)
    y = rng.random(20000) < 0.4
    rates = [0.95, 0.9, 0.85, 0.8, 0.75, 0.6]
    votes = np.stack([np.where(rng.random(len(y)) < r, y, ~y) for r in rates], 1) * 2 - 1
    counts = Counter((0, tuple(int(v) for v in row)) for row in votes)
    found, p = pii.estimate(counts)
    for j, r in enumerate(rates):
        assert abs(found[0, j] - r) < 0.05
    right = sum(n if (p[k] > 0.5) == (sum(w * v for w, v in zip([3, 2.2, 1.7, 1.4, 1.1, .4], k[1], strict=True)) > 0) else 0
                for k, n in counts.items())
    assert right > 0.95 * len(y)


# -- language ------------------------------------------------------------
def test_language_held_out(spark):
    docs = given(spark, "documents", "/root/testdata/sf0.01")
    got = langid.identify(docs, langid.fit(docs)).select("row.doc_id", "row.text", "row.lang", "lang_pred", "score",
                                                         "rejected", langid.held_out(queries.F.col("row.doc_id")).alias("h"))
    rows = got.collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    test = [r for r in rows if r["h"] and r["lang"] is not None and r["lang_pred"] != "und"]
    assert len(test) > 150 and sum(r["lang"] == r["lang_pred"] for r in test) / len(test) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["rejected"] for r in rows) < 0.02 * len(rows)
    for r in rows:
        assert (r["lang_pred"] == "und") == (not langid.has_letter(r["text"]))


def test_language_edges(spark):
    docs = edge_docs(spark)
    got = langid.identify(docs, langid.fit(docs))
    assert got.select("row.*").schema == docs.schema and got.count() == docs.count()
    none = {r["lang_pred"] for r in langid.identify(docs, langid.fit(empty(spark))).collect()}
    assert none == {"und"}
    one = docs.withColumn("lang", queries.F.lit("xx"))
    pred = langid.identify(one, langid.fit(one)).select("row.text", "lang_pred", "score").collect()
    assert all((r[1], r[2]) == (("xx", 1.0) if langid.has_letter(r[0]) else ("und", 0.0)) for r in pred)
    assert rows_of(langid.identify(empty(spark), langid.fit(docs))) == []


def test_pii_added_spans(spark):
    """On the given documents: every planted secret is a span, and of the
    numbers that only look like cards or addresses next to none is."""
    import re
    from pyspark.sql import functions as F
    rows = given(spark, "documents", "/root/testdata/sf0.01").select("doc_id", "text")
    got = {r["doc_id"]: {(pii.ALL_KINDS[k], s, e) for k, s, e in r["spans"]} - {(pii.ALL_KINDS[k], s, e) for k, s, e in r["base"]}
           for r in pii.find_pii(rows).collect()}
    planted, likeness = set(), set()
    for doc, text in rows.where(F.col("text").isNotNull()).collect():
        planted |= {(doc, "secret", m.start(1), m.end(1)) for m in re.finditer(r'token = "([0-9a-f]{40})"', text)}
        base = set(brute_pii(text))
        likeness |= {(doc, "card", m.start(), m.end()) for m in re.finditer(r"(?<![0-9])[0-9]{16}(?![0-9])", text)
                     if ("card", m.start(), m.end()) not in base}
    added = {(d, *x) for d, spans in got.items() for x in spans}
    assert planted and len(planted & added) >= .9 * len(planted)
    assert likeness and len(likeness & added) <= .1 * len(likeness)
    assert len(added & planted) >= .9 * len(added)
