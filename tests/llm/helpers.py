"""Fixtures shared by the tests of this folder."""

from __future__ import annotations

import random

SF001 = "/root/testdata/sf0.001"

#: Names that operators use inside: extra columns of these names must do no harm.
CLASHING = ("row", "hash", "hashes", "kept", "n", "start", "fp", "digest", "spans", "found", "length")


def edge_rows() -> list[tuple[int | None, str | None]]:
    rng = random.Random(4)
    passage = " ".join(f"word{i}" for i in range(60))
    long_line = " ".join(rng.choice(["alpha", "Beta,", "gamma.", "für", "1234", "x@y.example.com"]) for _ in range(30000))
    return [
        (1, None), (2, ""), (3, " \t\n\v\f\r "), (4, "a"), (5, "one two three"), (6, passage), (7, passage.upper()),
        (8, passage + " tail"), (9, passage), (9, passage), (10, long_line), (11, "z" * 70000),
        (12, "A shared line of some length\nshort\n  a SHARED line of some length\t\nend"),
        (13, "A shared line of some length\nmore"), (14, "x\nA shared line of some length"),
        (15, "Straße ÄÖÜ ein langer Satz mit Umlauten\n" * 3), (16, "Straße ÄÖÜ ein langer Satz mit Umlauten"),
        (17, "straße ÄÖÜ ein langer Satz mit Umlauten"), (18, "日本語のとても長い行がここにあります。はい、そうです\n日本"),
        (19, "日本語のとても長い行がここにあります。はい、そうです"), (20, "日本語のとても長い行がここにあります。はい、そうです"),
        (21, "mail me: a.b@c.example.com, 10.0.0.255 or 256.1.1.1; 1.2.3.4.5"),
        (22, "card 4111 1111 1111 1111 and 4111-1111-1111-1112, +1 (743) 555-3824. +49 30 123 (0"),
        (23, "9" * 5000 + " " + "a" * 5000 + "@" + "+" * 50 + "1.1.1.1%b@c.d_e@f.g"),
        (24, "call (555) 123-4567 or write joe (at) mail (dot) com; amex 3782 822463 10005"),
        (25, "<|endoftext|> It's   we'll\n\n\nnew\r\n İstanbul ﬁne ½"), (26, "İ" * 50 + "́x " + "Σ" * 5 + "<|endo"),
        (None, "A shared line of some length"), (None, passage), (-5, "  A shared line of some length"), (27, "\x00\x1f "),
    ]


def edge_docs(spark, extra: bool = True):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, t, "en" if t and t.isascii() else "de", "s", len(t or "")) for i, t in edge_rows()]
    if extra:
        schema += "".join(f", {c} int" for c in CLASHING)
        rows = [(*r, *range(len(CLASHING))) for r in rows]
    return spark.createDataFrame(rows, schema)


def given(spark, name: str, sf: str = SF001):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def both(spark):
    """The given documents and the edge cases, without extra columns."""
    docs = given(spark, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return docs.withColumn("doc_id", docs.doc_id + 1000).unionByName(edge_docs(spark, extra=False))


def empty(spark):
    return edge_docs(spark).limit(0)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
