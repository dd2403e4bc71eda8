"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, flac, language, minhash, packing, passages, resharding, spelling, topk, toxicity, urls, warc, whitening

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_flac": flac.op2_flac,
    "op3_passages": passages.op3_passages,
    "op4_language": language.op4_language,
    "op5_urls": urls.op5_urls,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_bpe": bpe.op7_bpe,
    "op8_topk": topk.op8_topk,
    "op9_minhash": minhash.op9_minhash,
    "op10_packing": packing.op10_packing,
    "op11_spelling": spelling.op11_spelling,
    "op12_whitening": whitening.op12_whitening,
    "op13_resharding": resharding.op13_resharding,
}

ORACLES = {"op1_warc": warc.OP1_SQL, "op3_passages": passages.OP3_SQL, "op5_urls": urls.OP5_SQL, "op8_topk": topk.OP8_SQL, "op9_minhash": minhash.OP9_SQL}
