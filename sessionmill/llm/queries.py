"""The queries of this package and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from sessionmill.llm import best_fit_packing, exact_dedup, hmm_lm, language_id, license_scan, license_scan_sql, periodic_runs, pfair_mix, quality_model, quality_rules, secret_scan, simhash, spelling_variants, substring_dedup

QUERIES = {
    "op1_substring_dedup": substring_dedup.query,
    "op2_best_fit_packing": best_fit_packing.query,
    "op3_exact_dedup": exact_dedup.query,
    "op4_pfair_mix": pfair_mix.query,
    "op5_quality_model": quality_model.query,
    "op6_simhash": simhash.query,
    "op7_quality_rules": quality_rules.query,
    "op8_license_scan": license_scan.query,
    "op9_hmm_lm": hmm_lm.query,
    "op10_language_id": language_id.query,
    "op11_secret_scan": secret_scan.query,
    "op12_spelling_variants": spelling_variants.query,
    "op13_periodic_runs": periodic_runs.query,
}

ORACLE_SQL = {
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op7_quality_rules": quality_rules.ORACLE,
    "op8_license_scan": license_scan_sql.ORACLE,
    "op12_spelling_variants": spelling_variants.ORACLE,
    "op13_periodic_runs": periodic_runs.ORACLE,
}
