"""The pipeline's last stage gives the token ids and compares what they decode to with the text."""

import public_tokenizers

import corpus_pipeline
from marlstone.llm import bpe


def test_stage_gives_ids_that_decode_to_the_text(spark):
    rows = [(1, "One text."), (2, None), (3, ""), (4, "É naïve\x85text " * 50)]
    out = corpus_pipeline.encode(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    coder, _ = bpe._coder(bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    texts = dict(rows)
    assert len(out) == 4 and all(r.decoded_ok for r in out)
    assert all(coder.decode_bytes(r.token_ids) == (texts[r.doc_id] or "").encode() and len(r.token_ids) == r.n_tokens for r in out)
