"""Queries of the pipeline operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from . import ann, codes, decontamination, language, licenses, lines, packing, phrases, repeats, revisits, scoring, sharding, simhash

_OPS = [packing.op1_window_packing, scoring.op2_stupid_backoff, lines.op3_deletion_line_dedup, ann.op4_additive_quantisation, decontamination.op5_fm_decontamination, repeats.op6_bwt_merge_repeats, sharding.op7_hash_tree_sharding, simhash.op8_simhash_near_duplicates, revisits.op9_revisit_resolution, language.op10_kneser_ney_language, licenses.op11_template_licenses, codes.op12_active_entry_codes, phrases.op13_misra_gries_phrases]

QUERIES = {f.__name__: f for f in _OPS}
ORACLE_SQL = {"op4_additive_quantisation": ann.OP4_SQL, "op2_stupid_backoff": scoring.OP2_SQL, "op3_deletion_line_dedup": lines.OP3_SQL, "op5_fm_decontamination": decontamination.OP5_SQL, "op6_bwt_merge_repeats": repeats.OP6_SQL, "op9_revisit_resolution": revisits.OP9_SQL, "op11_template_licenses": licenses.OP11_SQL, "op12_active_entry_codes": codes.OP12_SQL, "op13_misra_gries_phrases": phrases.OP13_SQL}
