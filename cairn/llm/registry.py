"""Queries of the numbered operators, each over its whole table, and their SQL where SQL can express them."""

from cairn.llm import decontamination, fingerprints, html_text, jaccard_join, phrases, quality, resharding, secret_scan, sentencepiece_codec, token_store, toxicity, url_lists, whitening

QUERIES = {
    "op1_token_output": token_store.op1_query,
    "op2_url_lists": url_lists.op2_query,
    "op3_fingerprints": fingerprints.op3_query,
    "op4_reshard": resharding.op4_query,
    "op5_jaccard_join": jaccard_join.op5_query,
    "op6_html_text": html_text.op6_query,
    "op7_decontamination": decontamination.op7_query,
    "op8_toxicity": toxicity.op8_query,
    "op9_sentencepiece": sentencepiece_codec.op9_query,
    "op10_secret_scan": secret_scan.op10_query,
    "op11_whitening": whitening.op11_query,
    "op12_collocations": phrases.op12_query,
    "op13_quality": quality.op13_query,
}
ORACLES: dict[str, str] = {"op2_url_lists": url_lists.OP2_SQL, "op5_jaccard_join": jaccard_join.OP5_SQL, "op12_collocations": phrases.OP12_SQL}
