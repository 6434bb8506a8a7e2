"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from cauceda.llm import bpe, exact_dedup, language_id, manifest, media, ngram_join, packing, resample, sharding, substring_dedup, token_files, toxicity, warc


def queries():
    return {
        "op1_ngram_jaccard_join": ngram_join.op1_ngram_jaccard_join,
        "op2_two_pass_shuffle": sharding.op2_two_pass_shuffle,
        "op3_byte_bpe": bpe.op3_byte_bpe,
        "op4_best_fit_packing": packing.op4_best_fit_packing,
        "op5_warc": warc.op5_warc,
        "op6_chunked_media": media.op6_chunked_media,
        "op7_language_id": language_id.op7_language_id,
        "op8_substring_dedup": substring_dedup.op8_substring_dedup,
        "op9_exact_dedup": exact_dedup.op9_exact_dedup,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_packed_token_files": token_files.op11_packed_token_files,
        "op12_merkle_manifest": manifest.op12_merkle_manifest,
        "op13_importance_resampling": resample.op13_importance_resampling,
    }


def oracle_sql():
    return {"op5_warc": warc.ORACLE, "op9_exact_dedup": exact_dedup.ORACLE, "op12_merkle_manifest": manifest.ORACLE, "op13_importance_resampling": resample.ORACLE}
