"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, benchmark
decontamination and packing over ``documents``.

Each stage is a function of (spark, docs, sf_dir) whose result is written as
Parquet and read again as the next one's documents.  All stages but the last
return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from branchdata.llm import decontam, langid, linededup, packing, simhash
from branchdata.llm.common import stored, table
from branchdata.llm.queries import WORD_TOKENIZER, tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier doesn't reject (it is trained
    on this stage's own labelled rows)."""
    return langid.identify(docs, langid.fit(docs)).where(~F.col("rejected")).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their repeated lines; n_chars follows the text."""
    changed = F.col("n_dropped") > 0
    new = {"text": F.when(changed, F.col("kept")).otherwise(F.col("row.text")),
           "n_chars": F.when(changed, F.length("kept")).otherwise(F.col("row.n_chars")).cast("long")}
    return linededup.line_dedup(docs).select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c)
                                               for c in docs.columns])


def _keyed(docs: DataFrame) -> DataFrame:
    """Each row with its id and the digest of its text."""
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("k"),
                       simhash.text_digest(F.col("text")).alias("t"))


def _same(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """``rows`` with (left_semi) or without (left_anti) those of ``keys`` (id,
    text_digest).  The size of a stored list is known when the join is planned,
    so a short one is broadcast and the texts stay where they are."""
    return rows.join(keys, F.col("k").eqNullSafe(F.col("id")) & (F.col("t") == F.col("text_digest")), how)


def _by_other_columns(docs: DataFrame):
    """Orders rows by their other columns; what has no order (maps) counts as JSON."""
    def ordered(t) -> bool:
        if isinstance(t, T.ArrayType):
            return ordered(t.elementType)
        if isinstance(t, T.StructType):
            return all(ordered(f.dataType) for f in t.fields)
        return not isinstance(t, (T.MapType, T.VariantType))
    plain = [F.col(f"row.`{f.name}`") for f in docs.schema.fields if ordered(f.dataType)]
    rest = [F.col(f"row.`{f.name}`") for f in docs.schema.fields if not ordered(f.dataType)]
    return F.struct(*plain, *([F.to_json(F.struct(*rest))] if rest else []))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group one row: that of the smallest id (null
    last), then of the smallest text digest.  Ids needn't be unique or
    present: rows of one id, or of none, with texts of different groups all
    stay, and of rows equal in id and text the least by their other columns."""
    keep = simhash.firsts(docs).select(F.col("doc_id").alias("id"), F.col("digest").alias("text_digest"), F.lit(True).alias("stays"))
    rows = _keyed(docs)
    groups = rows.groupBy("k", "t").agg(F.count(F.lit(1)).alias("n"))
    lists = stored(_same(groups, keep, "left").where("stays IS NULL OR n > 1")
                   .select(F.col("k").alias("id"), F.col("t").alias("text_digest"), "stays"), "not-once")
    # About a tenth of the rows go, at any size: the texts are shuffled once.
    once = _same(rows, lists.hint("shuffle_hash"), "left_anti").select("row.*")
    several = (_same(rows, lists.where("stays"), "left_semi").groupBy("k", "t")
               .agg(F.min_by("row", _by_other_columns(docs)).alias("row")))
    return once.unionByName(several.select("row.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    bad = stored(found.where("contaminated").select(F.col("doc_id").alias("id"), F.upper(F.hex("digest")).alias("digest_hex"))
                 .distinct(), "contaminated")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("k"),
                       F.upper(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).alias("t"))
    return _same(rows, bad.withColumnRenamed("digest_hex", "text_digest"), "left_anti").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of the documents that are left."""
    return packing.pack(docs, tokenizer_path(WORD_TOKENIZER), with_ids=False)


STAGES = [("language ID", language_id), ("line dedup", line_dedup), ("SimHash near-dedup", simhash_dedup),
          ("benchmark decontamination", decontaminate), ("packing", pack)]

#: SQL can't express the language classifier or the tokenizer; the pipeline is
#: tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
