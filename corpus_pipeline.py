"""From raw documents to packed training sequences.

Five stages, each one of the operators of ``lodestone.llm``: language
identification, line dedup, SimHash near-dedup, personal data, packing. Each
stage works on what its predecessor kept; its output is written as Parquet to
the shared folder and read back as the next one's input, so a lost executor or
a restarted driver costs a stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import language, line_dedup, packing, pii, simhash
from lodestone.llm.store import free_names, stored

#: Fingerprints of 64 bits in which near copies are looked for.
NEAR_COPY_WORDS = 8


def _with_text(docs: DataFrame, columns: list[str], text) -> DataFrame:
    """The given columns with a new text and its length."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return docs.select(*(new[c].alias(c) if c in new else F.col(c) for c in columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or a text; fills in a missing ``lang``, by ``und`` where no document can teach."""
    lang, score = free_names(docs, "_lang", "_score")
    model = language.train(docs)
    told = language.has_letter(F.col("text")) if model is None else F.col(lang) != language.UNDETERMINED
    found = language.identify(docs, model, into=(lang, score)).where(told)
    return found.select(*(F.coalesce("lang", lang).alias("lang") if c == "lang" else F.col(c) for c in docs.columns))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that an earlier document holds.

    A null text becomes the empty text. Rows that share an id are one document,
    a null id counts as the largest. An empty table gives an empty table.
    """
    return _with_text(line_dedup.dedup_lines(docs), docs.columns, F.col("text"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, the one with the smallest id.

    Near copies have a similarity of 0.8 or more in shingles of five words.
    All texts without a word are copies of one another. A null id comes last;
    of rows that repeat id and text one stays. An empty table gives an empty
    table.
    """
    return simhash.one_of_each_group(docs, shingle=5, words=NEAR_COPY_WORDS, similarity=0.8)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in brackets in the place of personal data; a text without any, null or empty, stays. Every row stays."""
    (into,) = free_names(docs, "_pii")
    found = pii.find(docs, into=into)
    return _with_text(found.withColumn("text", pii.redacted(F.col("text"), F.col(into))), docs.columns, F.col("text"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 2048 tokens; a null or empty text is its end token. Rows that repeat are packed as often."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]
#: The first stage learns from the documents and the last one packs; SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


QUERIES = {"pipeline": run}
SQL = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
