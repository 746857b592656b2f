"""The queries of the corpus operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import licenses, line_templates, minhash, mixing, phrases, quality, ranked, secrets, spaced_seeds, spelling, substrings, toxicity, url_cascade

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_cascade": url_cascade.op1_url_cascade,
    "op2_robust_quality": quality.op2_robust_quality,
    "op3_near_duplicates": minhash.op3_near_duplicates,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_repeated_phrases": phrases.op8_repeated_phrases,
    "op9_line_templates": line_templates.op9_line_templates,
    "op10_spaced_seed_decontamination": spaced_seeds.op10_spaced_seed_decontamination,
    "op11_repeated_substrings": substrings.op11_repeated_substrings,
    "op12_ranked_search": ranked.op12_ranked_search,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

SQL: dict[str, str] = {
    "op1_url_cascade": url_cascade.SQL,
    "op4_license_scan": licenses.SQL,
    "op5_mix_sources": mixing.SQL,
    "op6_secret_scan": secrets.SQL,
    "op9_line_templates": line_templates.SQL,
    "op12_ranked_search": ranked.SQL,
}
