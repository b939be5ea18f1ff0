import hashlib

import public_tokenizers
import pytest
import tiktoken

from folio.llm import bpe

RANKS = bpe.parse_ranks(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
TEXTS = [
    "", None, "Hello world, it's fine.", "  many   spaces \n\n and tabs\t\t", "éàü 漢字かな 🙂🙂 Ünïcödé", "a" * 3000, "1234567890" * 50,
    "<|endoftext|> plain", "the the the", "\x00\x01\x02 control", "word" * 500 + "!?" * 300, "ΑΒΓδεζ عربى हिन्दी",
]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_same_ids_as_tiktoken_and_round_trip(spark, reference):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(1, TEXTS[2], "y"), (None, "no id", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.encode_and_decode(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert len(out) == len(rows)
    expected = sorted((t or "").encode() for _, t, _ in rows)
    assert sorted(bytes(r["decoded"]) for r in out) == expected
    for r in out:
        ids = list(memoryview(bytes(r["ids"])).cast("I"))
        assert ids == reference.encode_ordinary(bytes(r["decoded"]).decode()) and r["n_tokens"] == len(ids)


def test_random_bytes_match_merging():
    import random

    encoder, rng = bpe.BacktrackingEncoder(RANKS), random.Random(3)
    for _ in range(400):
        piece = bytes(rng.choice(b"abcdethe in\xc3\xa9\xff") for _ in range(rng.randint(1, 40)))
        if piece not in RANKS:
            assert encoder.encode_piece(piece) == bpe.merge_by_rank(piece, RANKS)


def test_documents_of_the_test_data(spark, reference):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    out = bpe.encode_and_decode(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for r in out.collect():
        want = b"".join(i.to_bytes(4, "little") for i in reference.encode_ordinary(texts[r["doc_id"]] or ""))
        assert hashlib.sha256(bytes(r["ids"])).digest() == hashlib.sha256(want).digest()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_and_decode(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


def test_very_long_texts(spark, reference):
    import random

    rng = random.Random(13)
    texts = {1: "".join(rng.choice("abc é漢\n'1 ") for _ in range(300_000)), 2: "z" * 100_000, 3: "ab" * 60_000 + " " * 50_000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in bpe.encode_and_decode(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect():
        assert bytes(r["decoded"]).decode() == texts[r["doc_id"]]
        assert list(memoryview(bytes(r["ids"])).cast("I")) == reference.encode_ordinary(texts[r["doc_id"]])
