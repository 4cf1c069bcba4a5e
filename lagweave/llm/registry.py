"""The numbered queries of this subpackage, and SQL for those that SQL can express."""

from . import bpe, exact_dedup, language, minhash, mixing, ngram_join, periodic, quality, spelling, substring_dedup, token_shards, url_filter, warc

QUERIES = {
    "op1_quality_rules": quality.op1,
    "op2_bpe": bpe.op2,
    "op3_warc": warc.op3,
    "op4_token_shards": token_shards.op4,
    "op5_exact_dedup": exact_dedup.op5,
    "op6_substring_dedup": substring_dedup.op6,
    "op7_ngram_join": ngram_join.op7,
    "op8_language_id": language.op8,
    "op9_url_filters": url_filter.op9,
    "op10_source_mixing": mixing.op10,
    "op11_spelling_variants": spelling.op11,
    "op12_minhash_dedup": minhash.op12,
    "op13_periodic_runs": periodic.op13,
}

SQL = {
    "op3_warc": warc.SQL,
    "op5_exact_dedup": exact_dedup.SQL,
    "op7_ngram_join": ngram_join.SQL,
    "op10_source_mixing": mixing.SQL,
    "op11_spelling_variants": spelling.SQL,
    "op12_minhash_dedup": minhash.SQL,
}
