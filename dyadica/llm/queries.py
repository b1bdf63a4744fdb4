"""The queries of this subpackage, and their SQL where there is any."""

from . import bpe, chat, fim, hmm, jaccard, neighbours, packing, quality, sharding, toxicity, trie, url_filter, warc


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_url_filter": url_filter.query,
    "op2_toxicity": toxicity.query,
    "op3_sharding": sharding.query,
    "op4_byte_bpe": bpe.query,
    "op5_packing": packing.query,
    "op6_chat_format": chat.query,
    "op7_quality": quality.query,
    "op8_warc": warc.query,
    "op9_jaccard": jaccard.query,
    "op10_neighbours": neighbours.query,
    "op11_fim": fim.query,
    "op12_hmm": hmm.query,
    "op13_prefix_trie": trie.query,
    "pipeline": _pipeline,
}
SQL = {"op1_url_filter": url_filter.SQL, "op3_sharding": sharding.SQL, "op6_chat_format": chat.SQL, "op8_warc": warc.SQL, "op11_fim": fim.SQL, "op13_prefix_trie": trie.SQL}
