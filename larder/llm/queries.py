"""The queries of this subpackage by name, and SQL for their rows where SQL can express them."""

from __future__ import annotations

from . import bpe, decontaminate, fill_in_middle, html_text, ngram_join, packing, periodic_runs, quality_rules, secret_scan, topk, toxicity, url_filter, warc

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_secret_scan": secret_scan.op4_secret_scan,
    "op5_html_text": html_text.op5_html_text,
    "op6_warc": warc.op6_warc,
    "op7_bpe": bpe.op7_bpe,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_top_k": topk.op9_top_k,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_decontamination": decontaminate.op12_decontamination,
    "op13_fill_in_middle": fill_in_middle.op13_fill_in_middle,
}

ORACLE_SQL = {**warc.ORACLE_SQL, **url_filter.ORACLE_SQL, **topk.ORACLE_SQL, **decontaminate.ORACLE_SQL, **fill_in_middle.ORACLE_SQL}
