"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, jaccard_join, langid, licenses, line_dedup, mixing, pii, prefix_trie, quality, secrets, turn_repair, url_filter, warc

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op2_pii": pii.op2_pii,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_language_id": langid.op5_language_id,
    "op6_warc": warc.op6_warc,
    "op7_source_mix": mixing.op7_source_mix,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_url_filter": url_filter.op11_url_filter,
    "op12_turn_repair": turn_repair.op12_turn_repair,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

SQL = {
    "op1_decontamination": decontaminate.OP1_SQL,
    "op3_line_dedup": line_dedup.OP3_SQL,
    "op6_warc": warc.OP6_SQL,
    "op8_license_scan": licenses.OP8_SQL,
    "op9_jaccard_join": jaccard_join.OP9_SQL,
    "op11_url_filter": url_filter.OP11_SQL,
    "op12_turn_repair": turn_repair.OP12_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}
