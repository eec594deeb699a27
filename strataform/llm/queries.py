"""Queries ``opN_<name>`` of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import flac, jaccard, langid, lm, mixing, neardup, pieces, pii, shard, tokens

QUERIES = {
    f.__name__: f
    for f in (
        flac.op1_flac_payloads,
        pii.op2_pii_lstm_crf,
        pieces.op3_sentencepiece_transducer,
        lm.op4_context_mixing_scores,
        neardup.op5_sorted_projections,
        jaccard.op6_jaccard_join,
        tokens.op7_token_sequences,
        mixing.op8_mix_to_targets,
        shard.op9_histogram_shards,
        langid.op10_language_id,
    )
}
ORACLE = {"op8_mix_to_targets": mixing.oracle()}
