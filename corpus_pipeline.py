"""From documents to packed training sequences in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before kept;
all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import best_fit, decontaminate, langid, line_dedup, part_enum
from tessera.llm.common import stored

def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned from the labelled ones; the rest goes.

    Null and empty texts and texts without letters are rejected, and so is all text if
    no language was learned.  Repeated rows share their fate; a tie of languages goes to
    the first by name.  An empty table stays empty.
    """
    found = langid.identify(docs, langid.fit(docs, held_out=None))
    # the score is no ground: a clean text in three languages has a low one
    return found.where(F.col("lang_pred") != "und").select(*docs.columns)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of other documents go; ``n_chars`` is that of what is left.

    Null text becomes empty.  Rows that share an id are one document; a null id keeps all
    its lines and takes none.  A document that loses all lines stays, with empty text.
    """
    out = line_dedup.line_dedup(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each near-duplicate group stays.

    Of repeated rows one stays.  Texts without words (null, empty, blank) have no group and
    all stay; a row with a null id goes if its group has a row with an id.
    """
    return part_enum.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or with other values, go.

    Null and empty texts and rows with a null id stay; of rows that share an id all go if
    one leaks.  Without a benchmark's rows all stay.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1,024 tokens and their places in sequences.

    A null or empty text is one piece, the end token alone.  Repeated rows are pieces of
    their own; pieces of one length are placed by a hash of their id.
    """
    return best_fit.pack(stored(best_fit.token_pieces(docs, best_fit.default_tokenizer()), "pieces"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", drop_shared_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: SQL can't express the language model; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
