"""Queries of this subpackage and, where SQL can express them, their DuckDB statements."""

from tidepanel.llm import balltree, chat, chunks, maxscore, minhash, packing, phrases, pieces, pii, quality, tokens, toxicity, warc

QUERIES = {
    "op1_line_quality": quality.op1_line_quality,
    "op2_token_counts": tokens.op2_token_counts,
    "op3_pieces": pieces.op3_pieces,
    "op4_chat": chat.op4_chat,
    "op5_pack": packing.op5_pack,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_near_duplicates": minhash.op7_near_duplicates,
    "op8_top_k": maxscore.op8_top_k,
    "op9_warc": warc.op9_warc,
    "op10_pii": pii.op10_pii,
    "op11_phrases": phrases.op11_phrases,
    "op12_ball_tree": balltree.op12_ball_tree,
    "op13_bpe_chunks": chunks.op13_bpe_chunks,
}
STATEMENTS = {
    "op1_line_quality": quality.STATEMENT,
    "op4_chat": chat.STATEMENT,
    "op8_top_k": maxscore.STATEMENT,
    "op11_phrases": phrases.STATEMENT,
    "op12_ball_tree": balltree.STATEMENT,
    "op9_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
             g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
        FROM g""",
}
