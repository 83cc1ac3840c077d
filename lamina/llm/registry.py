"""Queries of this subpackage and the SQL that checks them."""

import corpus_pipeline

from . import bpe, decontam, langid, neardup, pii, quality, secrets, sharding, token_store, warc

QUERIES = {
    "op1_surrogates": pii.op1_surrogates,
    "op2_hypergeometric_shuffle": sharding.op2_hypergeometric_shuffle,
    "op3_unigram_language": langid.op3_unigram_language,
    "op4_repetition_coverage": quality.op4_repetition_coverage,
    "op5_addressable_codes": token_store.op5_addressable_codes,
    "op6_secret_entropy": secrets.op6_secret_entropy,
    "op7_gzip_normaliser": warc.op7_gzip_normaliser,
    "op8_weighted_minhash": neardup.op8_weighted_minhash,
    "op9_monoid_bpe": bpe.op9_monoid_bpe,
    "op10_seed_and_align": decontam.op10_seed_and_align,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL = {"op4_repetition_coverage": quality.ORACLE_SQL, "op6_secret_entropy": secrets.ORACLE_SQL, "op7_gzip_normaliser": warc.ORACLE_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
