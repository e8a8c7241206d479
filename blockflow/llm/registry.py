"""Queries of the corpus operators: name -> callable, and their SQL."""

from __future__ import annotations

from . import (collocations, decontaminate, embeddings, html_extract, langid, licenses, line_dedup, packing, piece_codec,
               prefix_trie, quality, sharding, simhash)

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_html_extract": html_extract.op2_html_extract,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_language_id": langid.op4_language_id,
    "op5_simhash_dedup": simhash.op5_simhash_dedup,
    "op6_feistel_shards": sharding.op6_feistel_shards,
    "op7_quality_qda": quality.op7_quality_qda,
    "op8_embedding_dedup": embeddings.op8_embedding_dedup,
    "op9_hilbert_pack": packing.op9_hilbert_pack,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_collocations": collocations.op11_collocations,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_sentencepiece": piece_codec.op13_sentencepiece,
}

SQL: dict[str, str] = {
    "op3_line_dedup": line_dedup.OP3_SQL,
}
