"""The registered queries of this subpackage and their SQL."""

from scrivana.llm import byte_bpe, fingerprints, language_id, mixing, packing, prefix_trie, quality, resampling, sharding, simhash, suffix_dedup, toxicity, url_filter

QUERIES = {
    f.__name__: f
    for f in (
        fingerprints.op1_syncmer_fingerprints,
        suffix_dedup.op2_suffix_dedup,
        toxicity.op3_toxicity,
        packing.op4_nnls_packing,
        language_id.op5_language_id,
        simhash.op6_simhash,
        quality.op7_fertility_rules,
        mixing.op8_mix_sources,
        sharding.op9_extendible_shards,
        url_filter.op10_url_filter,
        resampling.op11_importance_resampling,
        byte_bpe.op12_byte_bpe,
        prefix_trie.op13_prefix_trie,
    )
}
ORACLES = {
    "op8_mix_sources": mixing.ORACLE_SQL,
    "op9_extendible_shards": sharding.ORACLE_SQL,
    "op10_url_filter": url_filter.ORACLE_SQL,
}
