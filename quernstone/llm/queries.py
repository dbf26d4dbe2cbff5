"""The queries of this package and their SQL, for the driver."""

from __future__ import annotations

from quernstone.llm import crf, html, mixing, neardup, packing, phrases, rules, sharding, simjoin, spelling, suffixes, tokens, topk


def queries() -> dict:
    return {
        "op1_quality_rules": rules.op1_quality_rules,
        "op2_near_duplicates": neardup.op2_near_duplicates,
        "op3_source_mix": mixing.op3_source_mix,
        "op4_token_counts": tokens.op4_token_counts,
        "op5_quality_classifier": crf.op5_quality_classifier,
        "op6_html_extraction": html.op6_html_extraction,
        "op7_byte_shards": sharding.op7_byte_shards,
        "op8_best_fit_packing": packing.op8_best_fit_packing,
        "op9_exact_top_k": topk.op9_exact_top_k,
        "op10_suffix_dedup": suffixes.op10_suffix_dedup,
        "op11_phrase_collocations": phrases.op11_phrase_collocations,
        "op12_spelling_variants": spelling.op12_spelling_variants,
        "op13_jaccard_join": simjoin.op13_jaccard_join,
    }


def oracle_sql() -> dict[str, str]:
    return {**rules.oracle(), **mixing.oracle(), **topk.oracle(), **phrases.oracle()}
