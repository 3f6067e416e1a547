"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from sparkmill.llm import alignment, collocations, curves, density, jaccard, mixing, pfp, pivots, quality, secrets, sentencepiece_viterbi, sharding, warc_zip
from sparkmill.llm.common import table

#: Folder of the public vocabulary files at hand; operators take the files as arguments.
TOKENIZERS = "/opt/tokenizers"

QUERIES = {
    "op1_fourier_quality": lambda s, d: quality.score_documents(table(s, d, "documents"), table(s, d, "labels")),
    "op2_zip_warc": lambda s, d: warc_zip.roundtrip_digest(table(s, d, "pages")),
    "op3_hilbert_neighbours": lambda s, d: curves.nearest_neighbours(table(s, d, "embeddings")),
    "op4_prefix_free_parse": lambda s, d: pfp.repeat_digest(table(s, d, "documents")),
    "op5_token_group_jaccard": lambda s, d: jaccard.near_duplicates(table(s, d, "documents")),
    "op6_sentencepiece_viterbi": lambda s, d: sentencepiece_viterbi.token_rows(table(s, d, "documents")),
    "op7_hypergeometric_shards": lambda s, d: sharding.shard_documents(table(s, d, "documents")),
    "op8_secret_ledger": lambda s, d: secrets.secret_digest(table(s, d, "documents")),
    "op9_sainte_lague_mix": lambda s, d: mixing.mix_documents(table(s, d, "documents")),
    "op10_pivot_table": lambda s, d: pivots.top_products(table(s, d, "embeddings")),
    "op11_spill_alignment": lambda s, d: alignment.align_documents(
        table(s, d, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"),
    "op12_text_density": lambda s, d: density.extract(table(s, d, "pages")),
    "op13_parsed_collocations": lambda s, d: collocations.collocations(table(s, d, "documents")),
}

ORACLE: dict[str, str] = {"op2_zip_warc": warc_zip.SQL, "op10_pivot_table": pivots.SQL, "op13_parsed_collocations": collocations.SQL}
