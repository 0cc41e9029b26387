"""The queries of this subpackage by name, and their SQL twins."""

from freshet.llm import bpe, divergence, embedding_dedup, lexical_search, license_scan, main_text, mixing, ngram_join, packing, quality, toxicity, url_filters, warc

_NUMBERED = {
    "op1_warc": warc,
    "op2_main_text": main_text,
    "op3_ngram_join": ngram_join,
    "op4_packing": packing,
    "op5_url_filters": url_filters,
    "op6_mixing": mixing,
    "op7_toxicity": toxicity,
    "op8_license_scan": license_scan,
    "op9_embedding_dedup": embedding_dedup,
    "op10_quality_rules": quality,
    "op11_divergence": divergence,
    "op12_lexical_search": lexical_search,
    "op13_bpe": bpe,
}
QUERIES = {name: module.query for name, module in _NUMBERED.items()}
ORACLES = {name: module.ORACLE for name, module in _NUMBERED.items() if hasattr(module, "ORACLE")}
