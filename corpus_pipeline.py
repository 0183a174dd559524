"""The corpus pipeline: language, near duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on the whole of what the stage before kept. All
but the last return the columns of documents, n_chars being renewed where a text changes.

Rows, not ids, are documents: a null or repeated doc_id goes through all stages. Null texts and texts without a letter go
in the first stage, so that an input of these alone, or an empty one, gives an empty result. Repeated rows are near
duplicates, of which one stays; ties are settled by doc_id, then by a digest of doc_id and text, then by lang, source and n_chars in order. Texts are handled whole, however
long. Further columns of documents are not carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import language_id, minhash_dedup, packing, secrets, substring_dedup
from barloom.llm import common
from barloom.llm.common import durable

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_languages(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found: null texts and texts without a letter go, and only these, as every language
    of the labels is wanted. A null label is filled with the prediction; given labels stay. Known labels teach the
    prototypes; where there are none, texts with a letter stay without a language."""
    prototypes = language_id.fit(docs.where(~language_id.held_out()).select("doc_id", "text", "lang"))
    if not prototypes:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    found = language_id.predict(docs, prototypes, carry=["lang", "source", "n_chars"])
    return found.where("lang_pred <> 'und'").select("doc_id", "text", F.coalesce("rest.lang", "lang_pred").alias("lang"), "rest.source", "rest.n_chars")


def drop_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest doc_id, rows without an id coming last. Rows are
    found by a key of doc_id and text, so different texts under one doc_id stay apart. Rows without words all stay."""
    rows = docs.withColumn("row_key", minhash_dedup.row_key())
    groups = minhash_dedup.near_duplicates(docs).where("class is not null").groupBy("group")
    best = groups.agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("x"))
    # A key's rows share doc_id and text; of their other columns the least in order stays, nulls first.
    other = F.min(F.struct("lang", "source", "n_chars")).alias("rest")
    found = rows.join(best.select("x.row_key"), "row_key").groupBy("row_key").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), other).select("doc_id", "text", "rest.*")
    wordless = docs.where(~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return found.select(*COLUMNS).unionByName(wordless.select(*COLUMNS))


def cut_repeated_passages(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that stand elsewhere too are cut; documents with nothing left go."""
    cut = substring_dedup.remove_repeated_passages(docs, carry=["lang", "source", "n_chars"])
    text = F.col("kept_text")
    n_chars = F.when(F.col("n_removed") > 0, F.length(text).cast("long")).otherwise(F.col("rest.n_chars"))
    return cut.where("n_removed = 0 or n_removed < n_words").select("doc_id", text.alias("text"), "rest.lang", "rest.source", n_chars.alias("n_chars"))


def hide_secrets(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, but for examples that many owners hold."""
    shown = secrets.redact(docs)
    return shown.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 ids along the curve. Workers live through all stages, so they remember fewer words here."""
    return packing.pack_along_curve(docs, room=100_000)


STAGES = [
    ("language_id", keep_languages),
    ("minhash_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("secret_scan", hide_secrets),
    ("packing", pack),
]

#: No SQL: languages are learned, and packing follows a tokenizer and a curve. tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs, first = spark.read.parquet(f"{sf_dir}/documents.parquet"), len(common.WRITTEN)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = durable(docs)
            common.release(spark, since=first, keep=1)  # the stage's own tables, and the stage before
    return docs
