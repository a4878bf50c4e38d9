"""The corpus queries that ``__spark_entry__.py`` offers, with SQL where SQL can express them."""

from . import chat, clustering, embedding_dedup, exact_dedup, html_extract, language_id, mixing, neighbours, phrases, pieces, simhash, substring_dedup, toxicity

QUERIES = {
    "op1_exact_dedup": exact_dedup.query,
    "op2_language_id": language_id.query,
    "op3_simhash": simhash.query,
    "op4_html_extraction": html_extract.query,
    "op5_toxicity": toxicity.query,
    "op6_substring_dedup": substring_dedup.query,
    "op7_neighbours": neighbours.query,
    "op8_source_mixing": mixing.query,
    "op9_sentencepiece": pieces.query,
    "op10_chat_formatting": chat.query,
    "op11_clustering": clustering.query,
    "op12_phrases": phrases.query,
    "op13_embedding_dedup": embedding_dedup.query,
}

SQL = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op6_substring_dedup": substring_dedup.SQL,
    "op8_source_mixing": mixing.SQL,
    "op10_chat_formatting": chat.SQL,
    "op11_clustering": clustering.SQL,
    "op12_phrases": phrases.SQL,
    "op13_embedding_dedup": embedding_dedup.SQL,
}
