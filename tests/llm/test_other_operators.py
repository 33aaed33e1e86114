"""Nearest neighbours, pages, conversations and the pipeline."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given as cases
from hypothesis import settings
from hypothesis import strategies as st

from branchdata.llm import chat, mih, pagediff, queries
from tests.llm.helpers import SF001, edge_docs, empty, given, rows_of


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


# -- nearest neighbours --------------------------------------------------
def brute_nearest(ids, x, q, k=10):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != ids[q]][:k]
    return [(int(ids[i]), float(d[i])) for i in order]


def test_recall_and_exact_scores(spark):
    sf = "/root/testdata/sf0.1"
    rows = given(spark, "embeddings", sf).collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    got = {}
    for r in sorted(queries.op1_multi_index_hashing(spark, sf).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {int(i) for i in ids if i % 100 == 0}
    hit = total = 0
    at = {int(i): n for n, i in enumerate(ids)}
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        for _, v, s in found:
            assert s == pytest.approx(np.sqrt(((x[at[v]] - x[at[q]]) ** 2).sum()), abs=1e-12)
        want = {v for v, _ in brute_nearest(ids, x, at[q])}
        hit += len(want & {v for _, v, _ in found})
        total += 10
    assert hit / total >= 0.95


@pytest.mark.parametrize("bits", [64, 20])
def test_probing_finds_every_code_in_the_radius(bits):
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) & np.uint64((1 << bits) - 1 if bits < 64 else 2**64 - 1)
    codes[1000:1500] = codes[0] ^ (np.uint64(1) << rng.integers(0, bits, 500).astype(np.uint64))
    shard = mih.Shard(np.arange(3000), np.zeros((3000, 2)), codes, bits)
    for r in (0, 1, 2, 3, 5, 8, 13, 20, bits):
        for c in codes[:20]:
            assert shard.within(c, r).tolist() == np.flatnonzero(np.bitwise_count(codes ^ c) <= r).tolist()


def test_vectors_that_take_no_part(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(v) for v in rng.normal(size=8)]) for i in range(300)]
    rows += [(300, rows[5][1]), (301, rows[5][1]), (300, rows[5][1]), (400, None), (500, [0.0] * 8), (600, [1.0] * 7 + [None]),
             (700, [float("nan")] * 8), (800, [float("inf")] * 8), (900, [1.0, 2.0]), (None, rows[0][1]), (1000, [])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, code int, q int")
    index, codes = mih.build_index(df)
    got = mih.search(index, codes, index.where("vec_id % 100 = 0"), k=12).collect()
    assert {r["query_id"] for r in got} == {0, 100, 200, 300}
    near = [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 300]
    assert near[:2] == [(5, 0.0), (301, 0.0)] and len(near) == 12 and len({v for v, _ in near}) == 12
    few, few_codes = mih.build_index(df.where("vec_id < 4"))
    assert len(mih.search(few, few_codes, few.where("vec_id = 0")).collect()) == 3
    none, no_codes = mih.build_index(df.limit(0))
    assert rows_of(mih.search(none, no_codes, none)) == []


def test_query_blocks_and_shards_give_the_same(spark):
    index, codes = mih.build_index(given(spark, "embeddings"))
    asked = index.where("vec_id % 50 = 0")
    one = rows_of(mih.search(index, codes, asked))
    assert rows_of(mih.search(index, codes, asked, query_block=3, shard_rows=64)) == one


# -- pages ---------------------------------------------------------------
@settings(max_examples=200, deadline=None)
@cases(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=12))
def test_longest_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    places = pagediff.shared(a, b)
    assert places == sorted(set(places)) and len(places) == table[-1][-1]
    it = iter(b)
    assert all(a[p] in it for p in places)         # a subsequence of b


def test_given_pages(spark):
    got = {r["page_id"]: r for r in pagediff.main_text(given(spark, "pages", "/root/testdata/sf0.01")).collect()}
    import html
    for r in given(spark, "pages", "/root/testdata/sf0.01").collect():
        article = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split())
                  for b in re.split(r"</?(?:p|h1)>", article)]
        text = "\n\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["text"] == text and got[r["page_id"]]["n_chars"] == len(text)
        assert got[r["page_id"]]["url"] == r["url"]


ARTICLE = """<html><head><title>t</title></head><body><header>Site</header><nav>menu</nav><main><h1>Head &amp; line</h1>
<p>First <b>bold</b>&nbsp;text<br>next <script>var x="<p>no</p>";</script>end<p>Second &lt;tag&gt; a < b
<aside>side</aside><form><input value="a>b">f</form><div class="cookie-notice">cookies</div><ul><li>One<li>Two</ul>
<section id="comments"><article class="comment">said</article></section></main><footer>foot</footer><!-- c > --></body>"""


def test_markup(spark):
    kinds = pagediff.lines(ARTICLE)
    assert [t for k, t in kinds if k == "main"] == ["Head & line", "First bold text next", "end", "Second <tag> a < b", "One", "Two"]
    assert not any(k == "open" for k, _ in kinds)


def page(*blocks: str) -> str:
    return "<body>" + "".join(f"<div>{b}</div>" for b in blocks) + "</body>"


@pytest.mark.parametrize("piece", [1, 2, 512])
def test_differencing(spark, piece):
    menu, legal = "Home and news", "All rights reserved"
    rows = [(i, f"http://www.h.example/a/{i:02d}", page(menu, f"story {i} one", f"story {i} two", legal)) for i in range(9)]
    rows += [(20, "http://h.example/a/03?copy", rows[3][2]), (20, "http://h.example/a/03?copy", rows[3][2]),
             (30, "http://other.example/x", page("alone", menu)), (40, None, None), (41, "http://[bad", ""),
             (42, "http://h.example/z", "<body></body>"), (None, "http://h.example/a/zz", page(menu, "null id", legal))]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, n int, text string")
    got = [(r["page_id"], r["text"]) for r in pagediff.main_text(df, piece=piece).collect()]
    assert len(got) == len(rows)
    texts = dict(got)
    for i in range(9):
        assert texts[i] == f"story {i} one\n\nstory {i} two"
    assert [t for i, t in got if i == 20] == [texts[3]] * 2
    assert texts[30] == "alone\n\n" + menu and texts[40] == texts[41] == texts[42] == "" and texts[None] == "null id"
    assert rows_of(pagediff.main_text(df.limit(0))) == []


def test_differencing_under_a_long_template(spark):
    """Lines that the markup leaves out don't make two pages versions of one."""
    nav = "<nav><ul>" + "".join(f"<li>entry {i}</li>" for i in range(38)) + "</ul></nav><footer><p>a</p><p>b</p></footer>"
    stories = [[f"story {i} line {j}" for j in range(8)] for i in range(4)]
    rows = [(i, f"http://h.example/a/{i}", page("Home and news", *own, "All rights reserved") + nav) for i, own in enumerate(stories)]
    edited = [*stories[0][:7], "story edited"]
    rows += [(10, "http://v.example/1", page("Home", *stories[0]) + nav), (11, "http://v.example/2", page("Home", *edited) + nav),
             (20, "http://e.example/1", page("Home") + nav), (21, "http://e.example/2", "<body>" + nav + "</body>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in pagediff.main_text(df).collect()}
    for i, own in enumerate(stories):
        assert got[i] == "\n\n".join(own)
    assert got[10] == "\n\n".join(["Home", *stories[0]]) and got[11] == "\n\n".join(["Home", *edited])
    assert got[20] == "Home" and got[21] == ""


@pytest.mark.parametrize("wrapper", ["<div class='layout with-sidebar'>", "<div id='page' class='has-nav'>",
                                     "<section class='search-results'>", "<div class=form-page>", "<form id=all>",
                                     "<div class='search'>", "<div role='dialog'>"])
@pytest.mark.parametrize("name", ["article", "main"])
def test_marked_layout_keeps_the_article(spark, wrapper, name):
    close = f"</{re.match('<([a-z]+)', wrapper)[1]}>"
    story = f"<{name}><div class='article-header'><h1>Title {{0}}</h1></div><p>Body {{0}}</p><div class='ad-slot'>Buy</div>" \
            f"<div class='cookie-notice'>cookies</div><div class='ad'>ad {{0}}</div></{name}>"
    rows = [(i, f"http://h.example/a/{i}", f"<body>{wrapper}{story.format(i)}<nav>menu</nav>{close}</body>") for i in range(3)]
    rows.append((9, "http://alone.example/", rows[0][2]))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in pagediff.main_text(df).collect()}
    assert got == {i: f"Title {i}\n\nBody {i}" for i in range(3)} | {9: "Title 0\n\nBody 0\n\nBuy"}


@pytest.mark.parametrize("wrapper", ["<nav>", "<aside>", "<footer>", "<div class='sidebar left'>", "<section id=comments>",
                                     "<li class='comment even'>"])
def test_articles_of_asides_and_comments_are_left_out(wrapper):
    name = re.match("<([a-z]+)", wrapper)[1]
    got = pagediff.lines(f"<main><p>own</p>{wrapper}<article><p>card</p></article></{name}></main>")
    assert got == [("main", "own"), ("out", "card")]


# -- conversations -------------------------------------------------------
def conversations(spark):
    rng = random.Random(2)
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in
            given(spark, "conversations", "/root/testdata/sf0.01").collect()]
    for c in (-1, -2):
        rows += [(c, i, ["user", "assistant"][i % 2], " ".join(rng.choice(["<|im_end|>", "a&b", "[INST]", "&lt;", "x"])
                                                                for _ in range(rng.randint(0, 60)))) for i in range(150)]
    rows += [(-2, -1, "system", "be [kind] & <brief>"), (-3, 0, None, None), (-3, None, "assistant", "early"), (-3, 0, "a\nb", "&#10;"),
             (-4, 5, "assistant", "same"), (-4, 5, "assistant", "same"), (None, 1, "user", "q"), (None, 0, "assistant", ""),
             (-5, 0, "assistant", "w " * 5000), (-6, 1, "system", "only"), (-8, 1 << 40, "user", "far"), (-8, 2, "assistant", "near")]
    return rows


def test_chat(spark):
    rows = conversations(spark)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, window int, n int")
    windows = chat.chat_windows(df).cache()
    got = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    assert set(got) == set(by)
    low = lambda x: (x is not None, x)                                        # noqa: E731
    for c, turns in by.items():
        turns.sort(key=lambda r: (low(r[1]), r[2] or "", r[3] or ""))
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns"] == "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        assert got[c]["loss_text"] == "".join(r[3] or "" for r in turns if r[2] == "assistant")
    w = windows.collect()
    assert all("[" not in r["formatted"] and re.fullmatch(r"(<\|im_start\|>[^<]*<\|im_end\|>\n)+", r["formatted"]) for r in w)
    assert all(r["n_tokens"] <= chat.BUDGET for r in w if r["conv_id"] in (-1, -2))
    for r in w:
        if r["conv_id"] == -2:
            assert r["formatted"].startswith("<|im_start|>system\nbe &#91;kind]") and r["n_repeated"] == (0 if r["window"] == 0
                                                                                                          else r["n_repeated"])
    assert any(r["n_repeated"] > 1 for r in w if r["conv_id"] == -2) and len([r for r in w if r["conv_id"] == -2]) > 5
    assert rows_of(chat.read_back(chat.chat_windows(df.limit(0)))) == []
    assert rows_of(chat.read_back(chat.chat_windows(df, block=3)).drop("formatted_chars")) == \
        rows_of(chat.read_back(windows).drop("formatted_chars"))


def test_chat_query(spark):
    out = queries.op9_chat_windows(spark, SF001)
    plan = out._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    row = next(r for r in out.collect() if r["conv_id"] == -7)
    said = "</s>[INST] ok [/INST]"
    assert row["turns_sha256"] == sha(f"user\n{said}\nassistant\n{said}\n")
    assert (row["n_turns"], row["loss_chars"], row["loss_sha256"]) == (2, len(said), sha(said))


def test_windows_keep_the_budget(spark):
    """Wherever a window's turns fit beside the system turn one by one."""
    rng = random.Random(6)
    sizes = {1: (0, [10] * 60 + [700] * 3), 2: (300, [700] * 4 + [20] * 40), 3: (0, [1020] * 3 + [5] * 80), 4: (516, [500] * 5 + [9] * 30),
             5: (50, [3000] + [30] * 60 + [940] * 4), 6: (600, [200] * 30), 7: (2000, [50] * 20)}
    rows, system = [], {}
    for c, (s, turns) in sizes.items():
        rng.shuffle(turns)
        system[c] = s + 4 if s else 0
        rows += [(c, -1, "system", "w " * s)] * (s > 0) + [(c, i, "user", "w " * n) for i, n in enumerate(turns)]
    rows += [(8, i, "user", "漢字" * 200) for i in range(6)] + [(9, i, "user", "x" * 4000) for i in range(6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.chat_windows(df).collect()
    texts = {}
    for r in got:
        turns = [x.split("<|im_end|>")[0].split("\n", 1)[1] for x in r["formatted"].split("<|im_start|>")[1:]]
        if r["conv_id"] < 8:
            own, n = system[r["conv_id"]], [len(x.split()) + 4 for x in turns]
            assert r["n_tokens"] <= 1024 or own > 1024 or any(x + own > 1024 for x in n if x != own)
        else:
            assert r["n_tokens"] <= 1024
        texts.setdefault(r["conv_id"], []).extend(turns[r["n_repeated"]:])
    assert {c: len(x) for c, x in texts.items()} == {c: sum(r[0] == c for r in rows) for c in texts} and len(texts) == 9


# -- pipeline ------------------------------------------------------------
def test_pipeline(spark):
    """Each stage against a brute-force version on its own input, and the whole."""
    import corpus_pipeline as cp
    from tests.llm import test_text_operators as brute
    docs = given(spark, "documents").cache()
    items = [(r["item_id"], r["text"]) for r in given(spark, "benchmark").collect()]
    now = docs
    for name, stage in cp.STAGES:
        before = [tuple(r) for r in now.collect()]
        out = stage(spark, now, SF001).cache()
        after = {tuple(r) for r in out.collect()}
        if name != "packing":
            assert out.schema.names == docs.schema.names
        if name == "language ID":
            assert after <= set(before) and len(after) > 0.97 * len(before)
        elif name == "line dedup":
            want = brute.brute_lines([(r[0], r[1]) for r in before])
            assert {(r[0], sha(r[1] or "")) for r in after} == {(w[0], w[3]) for w in want}
            assert all(r[4] == len(r[1] or "") or r in before for r in after)
        elif name == "SimHash near-dedup":
            fps = {r[0]: brute.brute_fingerprint(r[1]) for r in before}
            root = brute.brute_components(list(fps.values()))
            least = {}
            for d in sorted(fps):
                least.setdefault(root[fps[d]], d)
            assert after == {r for r in before if r[0] in least.values()}
        elif name == "benchmark decontamination":
            bad = {h[0] for h in brute.brute_hits([(r[0], r[1]) for r in before], items) if h[2]}
            assert bad and after == {r for r in before if r[0] not in bad}
        else:
            assert out.groupBy("doc_id").agg({"length": "sum"}).count() == len(before)
        now = out
    assert rows_of(cp.run(spark, SF001).drop("sequence_id")) == rows_of(now.drop("sequence_id"))


def test_pipeline_stages_on_edges(spark):
    import corpus_pipeline as cp
    for start in (edge_docs(spark), empty(spark)):
        docs = start
        for name, stage in cp.STAGES:
            docs = stage(spark, docs, SF001)
            if name != "packing":
                assert docs.schema.names == start.schema.names
        docs.collect()


def test_simhash_stage_keeps_a_row_of_each_group(spark):
    """Null and repeated ids: each group of look-alikes gives its least row."""
    import corpus_pipeline as cp
    from tests.llm import test_text_operators as brute
    rng = random.Random(5)
    text = [" ".join(rng.choice(["ab", "cd", "ef", "gh", "ij", "kl"]) + str(rng.randint(0, 99)) for _ in range(40)) for _ in range(12)]
    rows = [(None, text[0], "en"), (None, text[1], "en"), (None, text[2], "en"), (None, text[2], "en"), (None, text[2], "de"),
            (1, text[3], "en"), (None, text[3], "en"), (None, text[3].upper(), "en"),
            (7, text[4], "en"), (7, text[5], "en"), (7, text[6], "en"), (7, text[6], "en"), (3, text[6], "en"),
            (8, text[7], "en"), (8, text[7].upper(), "en"), (9, None, "en"), (9, "", "en"), (None, " ", "en")]
    rows += [r for r in {(r[0], r[1], r[2]) for r in edge_docs(spark, extra=False).select("doc_id", "text", "lang").collect()}]
    fps = {r[1]: brute.brute_fingerprint(r[1]) for r in rows}
    root = brute.brute_components(list(fps.values()))

    def order(r):
        return r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest(), r[1] is not None, r[2]

    least = {}
    for r in sorted(rows, key=order):
        least.setdefault(root[fps[r[1]]], r)
    assert sum(r[0] is None for r in least.values()) >= 3 and sum(r[0] == 7 for r in least.values()) == 2
    for parts in (1, 7):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(parts)
        assert rows_of(cp.simhash_dedup(spark, docs, SF001)) == sorted(least.values(), key=repr)


# -- wrappers, comments, map columns ---------------------------------------
@pytest.mark.parametrize("page,want", [
    ('<body><form id="aspnetForm"><div><h1>T</h1><p>Body of it</p></div></form></body>', "T\n\nBody of it"),
    ('<body><div class="widget"><h1>T</h1><p>Body of it</p></div></body>', "T\n\nBody of it"),
    ('<body><div class="widget"><h1>T</h1><p>Body of it, rather long</p><nav>Menu</nav></div><footer>F</footer></body>',
     "T\n\nBody of it, rather long"),
    ('<article><h1>T</h1><p>Body</p><ul class="comment-list"><li>me too</li></ul><div class="user-comments">so</div>'
     '<div class="newsletter-box">Mail us</div></article>', "T\n\nBody"),
    ('<div class="comments-area"><p>one</p></div><article><p>Body</p></article>', "Body"),
    ('<form class="search-box"><p>Search it</p></form><div><p>Body text of the page, longer than the box</p></div>',
     "Body text of the page, longer than the box"),
    ('<div class="layout with-sidebar"><article><p>Body</p></article><div class="sidebar">Side</div></div>', "Body"),
])
def test_wrappers_and_comments(spark, page, want):
    df = spark.createDataFrame([(1, "http://a.example.com/x", page)], "page_id long, url string, html string")
    assert pagediff.main_text(df).first()["text"] == want


def test_pipeline_stages_keep_maps_and_structs(spark):
    from pyspark.sql import functions as F
    import corpus_pipeline
    docs = edge_docs(spark, extra=False).withColumns({
        "m": F.create_map(F.lit("a"), F.col("doc_id")), "s": F.struct(F.array(F.col("doc_id")).alias("x"))})
    docs = docs.unionByName(docs.where("doc_id = 9").withColumn("m", F.create_map(F.lit("b"), F.lit(1).cast("long"))))
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, SF001)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        assert out.count() > 0
    kept = corpus_pipeline.simhash_dedup(spark, docs, SF001).collect()
    assert len({(r.doc_id, r.text or "") for r in kept}) == len(kept)
