"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from discloq.llm import contamination, exact, language, links, packing, simhash, suffixes, tokens, toxicity, warc

QUERIES = {
    f.__name__: f
    for f in (
        toxicity.op1_toxicity, links.op2_url_filters, exact.op3_exact_dedup, warc.op4_warc, tokens.op5_token_counts,
        language.op6_language_id, packing.op7_best_fit_packing, simhash.op8_simhash, contamination.op9_decontamination, suffixes.op10_suffix_dedup,
    )
}

SQL = {"op2_url_filters": links.sql(), "op3_exact_dedup": exact.SQL, "op4_warc": warc.SQL}
