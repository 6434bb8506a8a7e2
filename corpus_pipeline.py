"""The corpus pipeline: toxic documents go, copies and near copies go, repeated passages go, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet to the
shared folder and reads it again as the next stage's documents. Null and empty texts pass every stage, and of texts that
are equal in full one stays; rows without an id are documents like others; rows that repeat both id and text stay or go
together; an empty table gives an empty result; further columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cauceda.llm import exact_dedup, ngram_join, packing, substring_dedup, toxicity
from cauceda.llm.common import crc_of_id, materialize, read_table


def drop_toxic(spark, docs, sf_dir):
    """Documents that score 0.5 or more go. The model learns from the labels that the scoring query learns from."""
    labels = read_table(spark, sf_dir, "labels").filter(crc_of_id("doc_id") % 5 != 0)
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def drop_copies(spark, docs, sf_dir):
    """Of equal texts the document with the largest id stays."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark, docs, sf_dir):
    """Of documents joined by links of similarity 0.8 or more the one with the smallest id stays."""
    return ngram_join.keep_one(docs)


def drop_repeated_passages(spark, docs, sf_dir):
    """Words under repeated 50-word windows go. A text that loses none stays as it is; documents all stay."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "n_chars"))
    found = substring_dedup.substring_dedup(docs, keep=rest)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text"))
    columns = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.length(text).cast("long")}
    return found.select(*(columns.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns))


def pack_sequences(spark, docs, sf_dir):
    """Pieces of at most 2048 tokens in sequences of at most 2048 tokens."""
    pieces = packing.tokenize(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(materialize(pieces, "pieces"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("best_fit_packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark, sf_dir):
    """The packed pieces of the documents of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
