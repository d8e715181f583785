"""Texts with very long runs encode to what each match of the pattern gives separately."""

import random

import public_tokenizers
import pytest
import regex

from marlstone.llm import bpe

LONG = 2_000_000


@pytest.fixture(scope="module")
def coder():
    return bpe._coder(bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)[0]


def each_match(coder, text):
    """The pattern's matches found by another library, white space as Unicode defines it, merged one by one."""
    pattern = public_tokenizers.PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
    return [i for m in regex.finditer(pattern, text) for i in coder._encode_single_piece(m[0])]


@pytest.mark.parametrize("run", [" ", "\n", "\u3000", " \n\t", "a", "-", "7", "\x1c", "\x85"])
@pytest.mark.parametrize("text", ["{}", "word{}", "{}word", "two words{}two\nwords", "{}!{}\n x"])
def test_long_runs(coder, run, text):
    whole = text.replace("{}", run * (LONG // len(run)))
    ids = bpe.encode_text(coder, whole)
    assert coder.decode_bytes(ids) == whole.encode()
    assert ids == each_match(coder, whole)


def test_runs_around_the_limits(coder):
    rng = random.Random(9)
    for _ in range(300):
        parts = [rng.choice([" ", "\n", "\u2028", "\x1c", "é", "it's", "12", "...", " a"]) * rng.choice([1, 2, 3, bpe.RUN_CHARS - 1, bpe.RUN_CHARS, bpe.RUN_CHARS + 1, bpe.RUN_CHARS + 2]) for _ in range(rng.randrange(1, 7))]
        whole = "".join(parts)
        assert bpe.encode_text(coder, whole, size=rng.choice([100, 5000, bpe.PIECE_CHARS])) == each_match(coder, whole)


def test_stage_takes_long_runs(spark):
    import corpus_pipeline

    rows = [(1, " " * LONG), (2, "a" + "\n" * LONG + "b"), (3, None)]
    got = corpus_pipeline.encode(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert len(got) == 3 and all(r.decoded_ok for r in got)
