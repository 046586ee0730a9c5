"""All queries of the training-data operators with their SQL twins (None: not expressible or too slow)."""

from __future__ import annotations

from backglot.llm import ann, bpe, chat, counts, decontaminate, idfiles, merkle, neardup, pagediff, periodic, quality, substrings, toxicity

QUERIES = {
    "op1_minhash_near_dedup": (neardup.op1_minhash_near_dedup, None),
    "op2_byte_bpe": (bpe.op2_byte_bpe, None),
    "op3_token_counts": (counts.op3_token_counts, None),
    "op4_id_files": (idfiles.op4_id_files, None),
    "op5_toxicity": (toxicity.op5_toxicity, None),
    "op6_substring_dedup": (substrings.op6_substring_dedup, substrings.OP6_SQL),
    "op7_quality": (quality.op7_quality, None),
    "op8_decontaminate": (decontaminate.op8_decontaminate, None),
    "op9_nearest_neighbours": (ann.op9_nearest_neighbours, None),
    "op10_chat_format": (chat.op10_chat_format, chat.OP10_SQL),
    "op11_merkle_manifest": (merkle.op11_merkle_manifest, merkle.OP11_SQL),
    "op12_periodic_runs": (periodic.op12_periodic_runs, None),
    "op13_html_text": (pagediff.op13_html_text, pagediff.OP13_SQL),
}
