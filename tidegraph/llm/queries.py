"""The queries of this package by name, with their SQL where SQL can express them."""

from __future__ import annotations

from . import clicks, credentials, digests, html, licenses, media, mixing, pieces, pii, simhash, suffixes, toxicity, vectors

QUERIES = {
    "op1_html_consensus": html.op1_html_consensus,
    "op2_simhash_trie": simhash.op2_simhash_trie,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_toxicity_cnn": toxicity.op5_toxicity_cnn,
    "op6_quartile_digest": digests.op6_quartile_digest,
    "op7_pieces_viterbi": pieces.op7_pieces_viterbi,
    "op8_suffix_levels": suffixes.op8_suffix_levels,
    "op9_media_signatures": media.op9_media_signatures,
    "op10_pii_anchors": pii.op10_pii_anchors,
    "op11_vector_codes": vectors.op11_vector_codes,
    "op12_click_windows": clicks.op12_click_windows,
    "op13_secret_network": credentials.op13_secret_network,
}

SQL = {"op4_mix_sources": mixing.OP4_SQL, "op11_vector_codes": vectors.OP11_SQL}
