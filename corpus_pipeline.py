"""Documents to packed training sequences: four stages, each written as Parquet and read again by the next.

Language ID drops documents without a recognisable language; near-dedup keeps one document of each group of
near-duplicates; decontamination drops documents that hold a benchmark item; packing gives the final pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import decontam, langid, minhash, packing
from sightline.llm.common import table, written

#: The score is the mean of the words' own probabilities of being of the language told: 0.25 for words that none of four
#: languages has shown, about 0.4 for texts of two languages.
MIN_SCORE = 0.3
#: Near copies of the stage: 0.80 or more of five-word shingles. A pair of 0.80 shares no bucket with probability 6.6e-7,
#: and agrees on fewer than 81 sketch values with 5e-7.
NEAR = minhash.Params(percent=80, bands=27, rows=4, alike=81)

#: What a worker of the last stage keeps and encodes at once: about 190 MB with all it needs, as executors come to the
#: stage with the heap of the ones before.
PACK = {"keep": 250_000, "part_chars": 1_000_000}


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has letters and whose language scores at least MIN_SCORE; learned from the rows not held out.

    Null, empty and letterless texts go. Each row is judged by its own text: a null doc_id, equal rows and rows that
    share an id change nothing; texts are read whole, whatever their length. An empty table stays empty; where no row
    has a lang, all rows with letters stay. All columns are passed on.
    """
    model = langid.fit(docs.where(~langid.held_out()), public_tokenizers.path("piece_bpe_32k.model"))
    return langid.recognised(docs, model, MIN_SCORE)


#: Names of rows without an id begin here; ids are below.
UNNAMED = 1 << 62


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates by NEAR, that of the smallest doc_id: its rows, less those equal
    to another in id and text.

    Null, empty and blank texts are near to nothing and stay. Rows that share a doc_id count as one document, so all
    its rows stay or go. Rows of null doc_id take part under a name made of their text, above all ids (which are below
    2**62): those of one text are one document, and they go where a document of an id is near. An empty table stays
    empty. All columns are passed on, whatever they are called.

    Texts are not moved, but for those of documents that go or that several rows share, and of the few that a bitmap
    can't tell from them; they meet an exact list.
    """
    name = "_name"
    while name in docs.columns:
        name += "_"
    hashed = F.xxhash64("text").bitwiseAND(F.lit(UNNAMED - 1)) + F.lit(UNNAMED)
    named = docs.withColumn(name, F.coalesce(F.col("doc_id").cast("long"), hashed))
    found = minhash.near_duplicates(named.select(F.col(name).alias("doc_id"), "text"), NEAR)
    seen = found.groupBy("doc_id").agg(F.count("*").alias("rows"), F.expr("bool_and(kept)").alias("kept"))
    watched = written(seen.where("rows > 1 or not kept").select(F.col("doc_id").alias(name), F.col("kept").alias(f"{name}kept")), "watched")
    marked = named.withColumn(f"{name}met", minhash.maybe_in(watched.select(name), F.col(name)))
    met = marked.where(f"{name}met").join(watched, name, "left")
    several = met.where(f"{name}kept").dropDuplicates([name, "text"])
    parts = [marked.where(f"not {name}met"), met.where(f"{name}kept is null"), several]
    kept = parts[0].select(*docs.columns)
    for part in parts[1:]:
        kept = kept.union(part.select(*docs.columns))
    return kept


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark item, each judged by its own text, whole, whatever its id or length.

    Null and empty texts hold no item and stay, as do all rows if there are no items; items of null id count. An empty
    table stays empty. All columns are passed on.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"), decontam.Params(unnamed=True))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the sequences, ids left out: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, crosses.

    A null or empty text is its end id; equal rows are packed each; a null doc_id is passed on; long texts run over
    many sequences. Other columns are not looked at. An empty table gives no pieces.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), **PACK).drop("ids")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return written(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])


ORACLE_SQL = None
