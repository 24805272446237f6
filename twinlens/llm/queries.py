"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import byte_bpe, embedding_dedup, jaccard_join, language_id, mixing, suffix_dedup, token_file, top_k, url_filter, warc

QUERIES = {
    f.__name__: f
    for f in (
        byte_bpe.op1_byte_bpe,
        embedding_dedup.op2_embedding_dedup,
        mixing.op3_mixing,
        top_k.op4_top_k,
        jaccard_join.op5_jaccard_join,
        warc.op6_warc,
        language_id.op7_language_id,
        token_file.op8_token_file,
        url_filter.op9_url_filter,
        suffix_dedup.op10_suffix_dedup,
    )
}
SQL = {"op3_mixing": mixing.OP3_SQL, "op4_top_k": top_k.OP4_SQL, "op9_url_filter": url_filter.OP9_SQL}
