"""The queries of this subpackage and the SQL that checks those SQL can express."""

from logloom.llm import (
    chat_format, decontaminate, line_dedup, packing, prefix_trie, quality, quality_classifier, simhash_dedup,
    structure_repair, substring_dedup, token_counts, toxicity, warc,
)

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_chat_format": chat_format.op2_chat_format,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_warc": warc.op4_warc,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_simhash_dedup": simhash_dedup.op7_simhash_dedup,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_pack": packing.op10_pack,
    "op11_quality_classifier": quality_classifier.op11_quality_classifier,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_structure_repair": structure_repair.op13_structure_repair,
}

ORACLES = {
    "op2_chat_format": chat_format.OP2_SQL,
    "op4_warc": warc.OP4_SQL,
    "op9_line_dedup": line_dedup.OP9_SQL,
    "op12_prefix_trie": prefix_trie.OP12_SQL,
    "op13_structure_repair": structure_repair.OP13_SQL,
}
