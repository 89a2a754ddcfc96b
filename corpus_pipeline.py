"""The cleaning pipeline over ``documents``: quality, toxicity, near duplicates, personal data, packing.

A stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame; all but the last return the columns of
``documents``. Rows with null or repeated ids are rows like any other; a null or empty text does not pass the quality rules.
"""

import public_tokenizers
from pyspark.sql import functions as F

from tidepanel.llm import minhash, packing, pii, quality, toxicity
from tidepanel.llm.common import materialize, table, text_or_empty

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words of a shingle of the near-duplicate stage.
SHINGLE = 5


def quality_rules(spark, docs, sf_dir):
    """Lines that fail a rule go; documents that the base or the loss of text rejects go."""
    # written first: a filter on top would move below the projections and evaluate the rules twice
    judged = materialize(quality.line_quality(docs, keep=["lang", "source"]).select("doc_id", "clean_text", "lang", "source", "kept"), "judged")
    return judged.where("kept").select("doc_id", F.col("clean_text").alias("text"), "lang", "source", F.length("clean_text").cast("long").alias("n_chars"))


def toxic_documents(spark, docs, sf_dir):
    """Documents that are predicted toxic go. The models are fitted on the labelled rows of this stage's input."""
    scored = toxicity.score(docs, table(spark, sf_dir, "labels"), keep=COLUMNS[1:])
    return scored.where("predicted = 0").select(*COLUMNS)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near duplicates stays: the one with the smallest id; of rows that repeat it, one. Different texts
    under one id are judged each for itself."""
    found = minhash.near_duplicates(docs, k=SHINGLE, detail=True).where("kept AND doc_id IS NOT NULL")
    # of several texts of one group under its smallest id, the one with the smallest digest
    best = found.groupBy("doc_id", F.coalesce(F.hex("root"), "digest").alias("__group")).agg(F.min("digest").alias("__digest")).select("doc_id", "__digest").distinct()
    known = docs.where("doc_id IS NOT NULL").withColumn("__digest", F.sha2(text_or_empty("text"), 256)).join(best, ["doc_id", "__digest"], "left_semi")
    return known.dropDuplicates(["doc_id", "__digest"]).select(*COLUMNS).union(docs.where("doc_id IS NULL").select(*COLUMNS))


def personal_data(spark, docs, sf_dir):
    """Every span of personal data is replaced by its kind in angle brackets."""
    found = pii.find_pii(docs, keep=["lang", "source"], mask=True)
    return found.select("doc_id", F.col("masked").alias("text"), "lang", "source", F.length("masked").cast("long").alias("n_chars"))


def packed(spark, docs, sf_dir):
    """Pieces of sequences of at most 4096 tokens."""
    return packing.pieces_with_crc(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxic_documents),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("packing", packed),
]
#: Boosted trees, sketches and byte-pair merges are beyond SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages to ``documents``; what a stage returns is written and read again for the next one."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage{k}")
    return docs
