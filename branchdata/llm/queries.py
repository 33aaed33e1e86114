"""The registered queries of this subpackage: each applies its operator, with
production parameters, to its whole table and returns the contract's columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from branchdata.llm import (chat, decontam, langid, linededup, mih, packing, pagediff, periodic, pii, simhash, tokencount,
                            tokenfiles, veccodes)
from branchdata.llm.common import scratch, table

WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


def op1_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, codes = mih.build_index(table(spark, sf_dir, "embeddings"))
    return mih.search(index, codes, index.where("vec_id % 100 = 0"))


def op2_pow2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(WORD_TOKENIZER), with_ids=False)


def op3_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op4_pii_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{k}")
              for i, k in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.written("base"), 256).alias("base_sha256"),
                        pii.written("spans").alias("spans"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    got = langid.identify(docs.select("doc_id", "text"), langid.fit(docs))
    return got.select("row.doc_id", langid.held_out(F.col("row.doc_id")).alias("held_out"),
                      "lang_pred", "score", "rejected")


def op6_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagediff.main_text(table(spark, sf_dir, "pages"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.line_dedup(docs).select("row.doc_id", "n_lines", "n_dropped",
                                             F.sha2("kept", 256).alias("kept_sha256"))


def op8_simhash_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') "
                      "AS t(conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    got = chat.read_back(chat.chat_windows(turns))
    return got.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"),
                      F.length("loss_text").cast("long").alias("loss_chars"),
                      F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars", "n_windows")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_TOKENIZER))


def restated(docs: DataFrame) -> DataFrame:
    """The contract's documents: where h % 10 = 0 (h the CRC32 of doc_id in
    decimal, g = h div 10) the words from a = g % n on repeat every
    p = 1 + (n - a) div (3 + g % 8) words.  A null doc_id changes nothing."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    cut = (docs.select("doc_id", "text", (h % 10 == 0).alias("again"), F.floor(h / 10).alias("g"))
           .withColumn("w", F.when(F.col("again"), words)).withColumn("n", F.size("w"))
           .withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
           .withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))))
    turned = F.transform("w", lambda w, i: F.when(i < F.col("a"), w).otherwise(
        F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return cut.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = periodic.periodic_runs(restated(table(spark, sf_dir, "documents")))
    # Of the longest runs the first: runs come by start, then period.
    longest = F.get(F.filter("runs", lambda r: r["length"] == F.array_max(F.transform("runs", lambda x: x["length"]))), F.lit(0))
    line = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    return (got.withColumn("top", longest)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
                    F.expr("1000L * top.length div top.period").alias("exponent_milli"),
                    F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
                    F.sha2("collapsed", 256).alias("collapsed_sha256")))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = veccodes.compress(table(spark, sf_dir, "embeddings"))
    return (veccodes.label_errors(codes)
            .select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error",
                    F.lit(veccodes.digest(books)).alias("codebooks_sha256")))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    tokenfiles.write(table(spark, sf_dir, "documents"), tokenizer_path(WORD_TOKENIZER), path)
    return tokenfiles.documents(tokenfiles.read(spark, path))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_multi_index_hashing, op2_pow2_packing, op3_positional_index, op4_pii_votes, op5_language_id,
        op6_page_differencing, op7_line_dedup, op8_simhash_bk_trees, op9_chat_windows, op10_token_counts,
        op11_periodic_runs, op12_vector_codes, op13_token_files)}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP3_SQL = rf"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, w[i:i + least(10, len(w)) - 1] AS ws, least(10, len(w)) AS size
  FROM item, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(i) WHERE len(w) > 0),
doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
hit AS (
  SELECT d.doc_id, d.i, win.item_id, win.size
  FROM (SELECT doc_id, i, size, w[i:i + size - 1] AS ws
        FROM doc, (SELECT DISTINCT size FROM win) s, unnest(range(1, len(w) - size + 2)) AS r(i)) d
  JOIN win ON win.ws = d.ws AND win.size = d.size),
words AS (
  SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hit, unnest(range(0, size)) AS r(j) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP7_SQL = rf"""
WITH doc AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
line AS (
  SELECT doc_id, i, ls[i] AS line,
         translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   '{_UPPER}', '{_LOWER}') AS k
  FROM doc, unnest(range(1, len(ls) + 1)) AS r(i)),
often AS (
  SELECT k, max(doc_id) AS kept FROM line WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE kept IS NOT NULL AND doc_id <> kept) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i)
                       FILTER (WHERE kept IS NULL OR doc_id = kept), '')) AS kept_sha256
FROM line LEFT JOIN often USING (k) GROUP BY doc_id
"""


# Codebooks are lists (entry by entry) per part; a round's nearest entry is the
# least of 64 * distance + entry.
_OP12_ROUND = """
near{i} AS MATERIALIZED (
  SELECT x.row, x.part, min(64 * list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))
                            + b.entry) AS best
  FROM cut x JOIN book{i} b USING (part) GROUP BY x.row, x.part)"""
_OP12_BOOK = """
mean{i} AS (
  SELECT part, CAST(best % 64 AS BIGINT) AS entry, p.k, CAST(floor(sum(v[p.k]) / count(*)) AS BIGINT) AS c
  FROM near{i} JOIN cut USING (row, part), unnest(range(1, (SELECT max(len(v)) FROM cut) + 1)) AS p(k)
  GROUP BY part, best % 64, p.k),
book{j} AS MATERIALIZED (
  SELECT part, entry, coalesce(m.v, b.v) AS v
  FROM book{i} b LEFT JOIN (SELECT part, entry, list(c ORDER BY k) AS v FROM mean{i} GROUP BY part, entry) m
       USING (part, entry))"""

OP12_SQL = """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
cut AS MATERIALIZED (
  SELECT row, part, v[1 + part * (len(v) // 16):(part + 1) * (len(v) // 16)] AS v
  FROM kept, unnest(range(16)) AS r(part)),
book0 AS MATERIALIZED (SELECT part, row - 1 AS entry, v FROM cut WHERE row <= 64),
""" + ",".join([_OP12_ROUND.format(i=0), _OP12_BOOK.format(i=0, j=1), _OP12_ROUND.format(i=1),
                _OP12_BOOK.format(i=1, j=2), _OP12_ROUND.format(i=2)]) + """,
coded AS MATERIALIZED (
  SELECT row, string_agg(lower(printf('%02x', CAST(best % 64 AS BIGINT))), '' ORDER BY part) AS code,
         CAST(sum(best // 64) AS BIGINT) AS error
  FROM near2 GROUP BY row),
words AS (
  SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, k)) AS digest
  FROM (SELECT part, entry, unnest(v) AS c, unnest(range(len(v))) AS k FROM book2))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT digest FROM words) AS codebooks_sha256
FROM kept JOIN coded USING (row)
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the operators that SQL can express."""
    return {"op3_positional_index": OP3_SQL, "op7_line_dedup": OP7_SQL, "op12_vector_codes": OP12_SQL}
