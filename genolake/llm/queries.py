"""Registered queries of the training-data operators."""

from __future__ import annotations

from genolake.llm import exact_dedup, language_id, minhash_join, packing, phrase_dedup, piece_nbest, quality_rules, simhash_golay, suffix_dedup, token_align, token_counts, warc, whitening
from genolake.session import table


def _docs(run):
    return lambda spark, sf_dir: run(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_offset_token_counts": _docs(token_counts.count_tokens),
    "op2_phrase_automata_dedup": _docs(phrase_dedup.report),
    "op3_tree_merge_exact_dedup": _docs(exact_dedup.report),
    "op4_exact_complement_packing": _docs(packing.pack),
    "op5_threshold_table_quality": _docs(quality_rules.report),
    "op6_suffix_family_dedup": _docs(suffix_dedup.report),
    "op7_nbest_pieces": _docs(piece_nbest.encode_decode),
    "op8_coordinate_minhash_dedup": _docs(minhash_join.report),
    "op9_mixture_language_id": _docs(language_id.report),
    "op10_arc_to_warc": lambda spark, sf_dir: warc.report(spark, table(spark, sf_dir, "pages")),
    "op11_pair_bitmap_alignment": _docs(token_align.report),
    "op12_golay_simhash_dedup": _docs(simhash_golay.report),
    "op13_multiplicity_whitening": lambda spark, sf_dir: whitening.report(table(spark, sf_dir, "embeddings")),
}

ORACLE_SQL = {
    "op3_tree_merge_exact_dedup": exact_dedup.ORACLE_SQL,
    "op5_threshold_table_quality": quality_rules.ORACLE_SQL,
    "op10_arc_to_warc": warc.ORACLE_SQL,
}
