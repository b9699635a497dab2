"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import ball_clusters, chat, classifier, fingerprints, licenses, lm, mixing, pieces, quality_rules, simhash, token_files, vector_codes, word_bpe


def queries() -> dict:
    return {
        "op1_fingerprints": fingerprints.op1_fingerprints,
        "op2_simhash": simhash.op2_simhash,
        "op3_sentencepiece": pieces.op3_sentencepiece,
        "op4_mixing": mixing.op4_mixing,
        "op5_chat": chat.op5_chat,
        "op6_licenses": licenses.op6_licenses,
        "op7_classifier": classifier.op7_classifier,
        "op8_token_files": token_files.op8_token_files,
        "op9_quality_rules": quality_rules.op9_quality_rules,
        "op10_lm": lm.op10_lm,
        "op11_vector_codes": vector_codes.op11_vector_codes,
        "op12_ball_clusters": ball_clusters.op12_ball_clusters,
        "op13_word_bpe": word_bpe.op13_word_bpe,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    return {"op4_mixing": mixing.OP4_SQL, "op11_vector_codes": vector_codes.OP11_SQL, "op12_ball_clusters": ball_clusters.OP12_SQL}
