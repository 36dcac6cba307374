"""The subpackage's queries and their SQL, as __spark_entry__.py registers them."""

from __future__ import annotations

from . import decontaminate, embeddings, fim, forced_bpe, jaccard, lm, mixing, quality, token_counts, token_store, toxicity, warc, whitening

QUERIES = {f.__name__: f for f in (token_counts.op1_edit_token_counts, warc.op2_warc_dictionary, quality.op3_quality_cnn, lm.op4_deleted_interpolation, embeddings.op5_embedding_dedup, mixing.op6_mix_sources, jaccard.op7_jaccard_join, toxicity.op8_toxicity_mil, token_store.op9_elias_fano_tokens, decontaminate.op10_decontaminate, fim.op11_fill_in_middle, forced_bpe.op12_forced_boundary_bpe, whitening.op13_tsqr_whitening)}

SQL = {"op2_warc_dictionary": warc.OP2_SQL, "op5_embedding_dedup": embeddings.OP5_SQL, "op6_mix_sources": mixing.OP6_SQL, "op7_jaccard_join": jaccard.OP7_SQL, "op10_decontaminate": decontaminate.OP10_SQL, "op11_fill_in_middle": fim.OP11_SQL}
