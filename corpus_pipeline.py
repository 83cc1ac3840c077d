"""A corpus from raw documents to token ids: five stages, each writing Parquet that the next one reads.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return the
columns of documents. Rows keep null ids; texts that are null leave with the first stage, which
rejects texts without enough words.
"""

from lamina.llm import bpe, decontam, neardup, quality, secrets
from lamina.llm.session import new_dir, table


def quality_rules(spark, docs, sf_dir):
    """Texts that repeat themselves too much, or are too short, go; so null and empty ones do. Each row is judged by its text
    alone: repeated rows go or stay together, and other columns, of any name and with nulls, stay as they are."""
    return quality.keep_clean(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document of each class of near-duplicates stays: that of the least doc_id, or one without if no other is there; of
    rows with equal ids and texts one stays. Null texts all stay; other columns stay as they are."""
    return neardup.keep_one(docs)


def decontamination(spark, docs, sf_dir):
    """Documents that contain a benchmark item, copied or edited, go, repeated rows together. Null and empty texts, and null and
    empty items, match nothing; with no item all rows stay, with their columns."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark, docs, sf_dir):
    """Secrets in texts are replaced by a mark, and n_chars follows where a text changed. Null texts stay null; every row
    stays, with its other columns."""
    return secrets.redact(docs)


def byte_bpe(spark, docs, sf_dir):
    """doc_id, n_tokens, digests and the token ids of each text, one row for each row; a null text is the empty one."""
    return bpe.encode_frame(docs, ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("byte_bpe", byte_bpe),
]


def run(spark, sf_dir):
    """The stages applied to documents, each stage's result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: No SQL: consistent sampling, alignment, entropy windows and byte pairs are beyond it; tests hold run() against brute force.
ORACLE_SQL = None
