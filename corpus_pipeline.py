"""The corpus pipeline: five stages over documents, each the next one's input as Parquet.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last
return the columns of documents, whatever these are called: names made here give way to theirs. Mixing
returns rows in mixed order, and packing fills sequences in the order of the rows each task reads. A stage
puts this folder on the path of Python workers itself, so it may be called without run().

Defined cases: null, empty and blank texts are scored like any other; a null text is never toxic and
is a near-duplicate class of its own; ties and repeated rows: rows that are equal or share an id are
one document to near-dedup, which keeps one row of it, and stay apart in every other stage; rows
with a null id are kept or dropped by their text alone; an empty table gives an empty result with
the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import mixing, neardup, packing, quality, toxicity
from gridloom.llm.common import cut, free_name, table
from gridloom.sources.shared import with_path

#: Least quality score and least toxicity score at which a document stays or goes.
LEAST_QUALITY, MOST_TOXIC = 0.3, 0.7


@with_path
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores at least LEAST_QUALITY."""
    model = quality.train_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    out = free_name(docs, "quality")
    return quality.score_quality(docs, model, out).where(F.col(out) >= LEAST_QUALITY).drop(out)


@with_path
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below MOST_TOXIC."""
    model = toxicity.train_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    out = free_name(docs, "toxicity")
    return toxicity.tag_toxicity(docs, model, out).where(F.col(out)["score"] < MOST_TOXIC).drop(out)


@with_path
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every near-duplicate class."""
    return neardup.deduplicate(docs)


@with_path
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, ordered by their place in the mixture."""
    out = free_name(docs, "mix")
    return mixing.mix(docs, out=out).orderBy(F.col(out)["position"]).drop(out)


@with_path
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [
    ("quality classifier", keep_quality),
    ("toxicity", drop_toxic),
    ("minhash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]

#: The stages learn models and throw hashed darts, which SQL cannot express; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
