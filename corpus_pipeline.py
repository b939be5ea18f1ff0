"""A corpus in four stages: toxic documents go, one of each group of near copies stays, repeated strings go, the rest is packed.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), and all but the last return the columns of docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import chosen_path, packing, suffixes, toxicity
from folio.llm.common import materialize, release, scratch, table


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a unique column, and its name (with which no column of docs begins): doc_id where that is unique and not null, else
    a running key of a written table."""
    key = "row_key"
    while any(c.lower().startswith(key) for c in docs.columns):
        key += "_"
    if not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count():
        return docs.withColumn(key, F.col("doc_id").cast("long")), key
    order = [F.col("doc_id").asc_nulls_last(), F.col("text")]
    return materialize(docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(key, F.monotonically_increasing_id()), "rows"), key


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go; all others, null and empty texts included, stay as they are.

    Rows that share an id, or have none, are judged each by its own text; labels are learned from by doc_id. Empty tables give
    an empty result, empty labels leave the operator's defaults. Columns beside doc_id and text pass through.
    """
    rows, key = _keyed(docs)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").join(rows.select("doc_id", key), "doc_id")
    scored = toxicity.score_documents(rows, labels, id_col=key, label_id_col="doc_id")
    rejected = materialize(scored.where("predicted = 1").select(key), "rejected")
    return rows.join(rejected.hint("merge"), key, "left_anti").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents linked by five-word shingles (similarity 0.8) the one of least id stays, unchanged.

    Null and empty texts are copies of each other, so one of them stays. Rows that share an id, or have none (they come last),
    are documents of their own in the order of (id, text). An empty table gives an empty result.
    """
    rows, key = _keyed(docs)
    classes = chosen_path.similar_documents(rows, id_col=key)
    copies = materialize(classes.where("not is_representative").select(key), "copies")
    return rows.join(copies.hint("merge"), key, "left_anti").select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that also start earlier are cut from the texts (in whole characters); every document stays.

    Null texts stay null. Rows that share an id, or have none, come in the order of (id, nulls last; text). An empty table
    gives an empty result. n_chars is counted anew, other columns pass through.
    """
    rows, key = _keyed(docs)
    gone = key + "_gone"
    found = suffixes.repeated_bytes(rows, id_col=key).where("n_removed > 0").select(key, F.col("spans").alias(gone))
    cut = rows.join(materialize(found, "spans").hint("merge"), key, "left")
    cut = cut.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(suffixes.without_spans(F.col("text"), F.col(gone))))
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens: one row per piece.

    Null and empty texts are one end token; null and repeated ids are packed as rows of their own. An empty table gives none.
    """
    pieces = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", drop_toxic), ("jaccard_join", drop_near_copies), ("suffix_dedup", drop_repeats), ("packing", pack)]

#: Learned scores and hashed walks are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, applied to all documents; what each keeps is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as kept:
            last, docs = docs, materialize(stage(spark, docs, sf_dir), name)
            kept.append(docs)
        release(last)
    return STAGES[-1][1](spark, docs, sf_dir)
