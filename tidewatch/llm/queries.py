"""The queries of this subpackage, and SQL for those that SQL can express."""

from . import bpe_codec, centroid_clustering, decontamination, html_extraction, language_id, lm_scoring, merkle_manifest, ngram_join, secret_scans, token_counts, topk_search, url_filters, warc

QUERIES = {
    "op1_url_filters": url_filters.query,
    "op2_lm_scoring": lm_scoring.query,
    "op3_language_id": language_id.query,
    "op4_decontamination": decontamination.query,
    "op5_ngram_join": ngram_join.query,
    "op6_topk_search": topk_search.query,
    "op7_secret_scans": secret_scans.query,
    "op8_html_extraction": html_extraction.query,
    "op9_token_counts": token_counts.query,
    "op10_bpe_codec": bpe_codec.query,
    "op11_centroid_clustering": centroid_clustering.query,
    "op12_merkle_manifest": merkle_manifest.query,
    "op13_warc": warc.query,
}

ORACLES = {"op4_decontamination": decontamination.ORACLE, "op6_topk_search": topk_search.ORACLE, "op7_secret_scans": secret_scans.oracle(), "op11_centroid_clustering": centroid_clustering.oracle(), "op12_merkle_manifest": merkle_manifest.oracle(), "op13_warc": warc.oracle()}
