import collections
import random
import zlib

import public_tokenizers
from tokenizers import Tokenizer

from folio.llm import packing

FILE = public_tokenizers.path("word_bpe_49k.json")


TOKENIZER = Tokenizer.from_file(FILE)


def whole_text_ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [2]


def test_special_tokens_and_runs_as_the_library_has_them():
    with open(FILE, encoding="utf-8") as f:
        own = packing.WordTokenizer(f.read(), 2)
    texts = ["x <|endoftext|> y", "a<|endoftext|>b", "<|startoftext|>", "<|endoftext|><|endoftext|>", "<|endoftext| >", "Ǆ ŉ ﬃ İ ß ͅα e\u0301 \u0345 क्षि", "don't can't've x's"]
    texts += [" ".join(chr(c) + "q" for c in range(0xA0, 0x3000) if not chr(c).isspace())]
    for text, ids in zip(texts, own.encode_many(texts), strict=True):
        assert ids == b"".join(i.to_bytes(4, "little") for i in whole_text_ids(text)), text[:20]
    assert whole_text_ids("x <|endoftext|> y") == [*TOKENIZER.encode("x", add_special_tokens=False).ids, TOKENIZER.token_to_id("<|endoftext|>"), *TOKENIZER.encode("y", add_special_tokens=False).ids, 2]


def check(rows, texts, limits=packing.Limits()):
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        want = b"".join(i.to_bytes(4, "little") for i in whole_text_ids(texts[doc]))
        pieces.sort(key=lambda r: r["start"])
        assert b"".join(bytes(p["ids"]) for p in pieces) == want
        assert all(p["doc_tokens"] == len(want) // 4 for p in pieces)
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= limits.tokens and len(pieces) <= limits.segments and sum(p["loss_tokens"] for p in pieces) <= limits.loss
        padding += 0 if at & (at - 1) == 0 else limits.tokens - at
    return padding


def test_documents_of_the_test_data(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    assert check(packing.pack_documents(df, FILE).collect(), texts) == 0


def test_nulls_long_texts_and_clashing_columns(spark):
    rows = [(1, None, 7), (2, "", 7), (3, "word née \x1c x y z <|endoftext|> Don't" * 3000, 7), (4, "a\tb\r\nc" * 10, 7), (5, "ΟΔΟΣ! İstanbul, क़ x́y don't DON'T... naïve?! n1 1n _a a_ (b) c's c'sd ﬁ ǅ 你好。", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sequence_id int")
    check(packing.pack_documents(df, FILE).collect(), {r[0]: r[1] for r in rows})
    repeated = packing.pack_documents(df.union(df), FILE).collect()
    assert sum(r["length"] for r in repeated) == 2 * sum(len(whole_text_ids(r[1])) for r in rows)
    assert packing.pack_documents(df.limit(0), FILE).count() == 0


def test_three_limits_at_once(spark):
    rows = [(i, "w " * (i % 97 + 1), i % 50) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, prompt long").coalesce(2)
    limits = packing.Limits(tokens=256, segments=5, loss=128)
    out = packing.pack_documents(df, FILE, limits=limits, prompt_tokens_col="prompt").collect()
    check(out, {r[0]: r[1] for r in rows}, limits)
    sequences = len({r["sequence_id"] for r in out})
    tokens, loss = sum(r["length"] for r in out), sum(r["loss_tokens"] for r in out)
    assert sequences <= 1.25 * max(tokens / 256, loss / 128, 900 / 5)


def test_crc32_is_sparks(spark):
    assert spark.sql("select crc32(X'0102FF') c").first()["c"] == zlib.crc32(b"\x01\x02\xff") == packing.crc32(b"\x01\x02\xff")


def test_null_and_repeated_ids(spark):
    rows = [(None, "one two"), (None, None), (7, "three"), (7, "three"), (7, "")]
    out = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), FILE).collect()
    want = sorted((r[0] or 0, len(whole_text_ids(r[1]))) for r in rows)
    assert sorted((r["doc_id"] or 0, r["doc_tokens"]) for r in out if r["start"] == 0) == want
    assert sum(r["length"] for r in out) == sum(n for _, n in want)


class BySize(packing.VectorPacker):
    """Takes the largest example that fits."""

    def score(self, size, *rest):
        return size.astype(float)


def packed(packer, examples):
    out = [p for k, (tokens, loss_from) in enumerate(examples) for p in packer.push(k, tokens, loss_from)] + packer.finish()
    pieces, bins = collections.defaultdict(list), collections.defaultdict(list)
    for key, start, length, sequence, offset in out:
        pieces[key].append((start, length))
        bins[sequence].append((offset, length, max(0, length - max(0, examples[key][1] - start))))
    for key, (tokens, _) in enumerate(examples):
        at = 0
        for start, length in sorted(pieces[key]):
            assert start == at
            at += length
        assert at == tokens
    limits = packer.limits
    for parts in bins.values():
        total = sum(p[1] for p in parts)
        assert len(parts) <= limits.segments and sum(p[2] for p in parts) <= limits.loss
        assert total == limits.tokens or total & (total - 1) == 0  # nothing is padded
    return len(bins)


def test_the_dot_product_beats_ordering_by_size_under_limits_that_bind():
    def big_prompts(rng):
        tokens = rng.randrange(800, 2500) if rng.random() < 0.5 else rng.randrange(50, 600)
        return tokens, int(tokens * (0.9 if tokens >= 800 else 0.05))

    def all_or_none(rng):
        tokens = int(rng.lognormvariate(6, 1)) + 1
        return tokens, tokens * (rng.random() < 0.5)

    limits = packing.Limits(segments=32, loss=2300, padded=False)
    for make in (big_prompts, all_or_none):
        rng = random.Random(3)
        examples = [make(rng) for _ in range(6000)]
        least = max(sum(t for t, _ in examples) / limits.tokens, sum(t - f for t, f in examples) / limits.loss)
        by_product, by_size = packed(packing.VectorPacker(limits), examples), packed(BySize(limits), examples)
        assert by_product < 0.95 * by_size and by_product < 1.05 * least


def test_prompt_share_and_the_query_s_limits_bind(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    limits = packing.Limits(segments=64, loss=3072, padded=False)
    rows = packing.pack_documents(df, FILE, limits=limits, prompt_share=0.5).collect()
    assert check(rows, {r["doc_id"]: r["text"] for r in df.collect()}, limits) == 0
    assert all(r["loss_tokens"] == r["length"] - min(r["length"], max(0, r["doc_tokens"] // 2 - r["start"])) for r in rows)
    loss = collections.Counter()
    for r in packing.pack_documents(df, FILE).collect():
        loss[r["sequence_id"]] += r["length"] - min(r["length"], max(0, r["doc_tokens"] // 2 - r["start"]))
    assert max(loss.values()) > limits.loss  # without the limit there are sequences beyond it
