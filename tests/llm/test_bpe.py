import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from hazardlake.llm import bpe
from hazardlake.llm.common import SLICE_BYTES, add_columns, slices
from hazardlake.llm.op2 import vocab_path

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    return tokenizers.Tokenizer.from_file(vocab_path())


def random_texts():
    rng = random.Random(4)
    bits = ["the", "Strasse", "straße", "éa", "é", "don't", "we'll", "İ", "ΣΑΣ", "x" * 70, "日本", "🙂", "123", "½", "_", "--", "!?",
            " ", "\n", "\t", " ", " ", "\x1c", "\x85", "<|endoftext|>", "<|startoftext|>", "<|", "ﬁ", "\x00"]
    return ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(0, 40))) for _ in range(400)]


@pytest.mark.parametrize("lexicon", [True, False])
def test_ids_and_decoding_equal_the_library(reference, lexicon):
    vocab = bpe.vocabulary(vocab_path())
    texts = random_texts() + ["", "a" * 5000, "ab" * 3000]
    lex = bpe.Lexicon(bpe.compile_lexicon(vocab, ["the", "strasse", "don't", "éa"])) if lexicon else None
    enc = bpe.Encoder(vocab, lex, memo_pieces=50)
    for text, ids in zip(texts, enc.encode(texts)):
        expected = reference.encode(text, add_special_tokens=False).ids
        assert ids == expected, text
        assert enc.decode(ids) == reference.decode(expected, skip_special_tokens=False)


def test_automaton_is_minimal_and_numbers_words():
    words = {w.encode(): [i, i + 1] for i, w in enumerate(["tap", "taps", "top", "tops", "a", "stop", "stops"])}
    flat = bpe.Lexicon.compile(words)
    lex = bpe.Lexicon(flat)
    found = lex.find([*words, b"ta", b"tapss", b"", b"zzz", b"t" * 500])
    assert (found[-5:] == -1).all()
    assert [lex.word_ids(n) for n in found[:7].tolist()] == list(words.values())
    assert int(flat[1]) < 1 + len({p for w in words for p in (w[:i] for i in range(len(w)))})   # suffixes are shared


def test_empty_lexicon():
    assert (bpe.Lexicon(bpe.Lexicon.compile({})).find([b"a", b""]) == -1).all()


def test_encode_and_decode_frames(spark, odd_docs, no_docs, reference):
    out = bpe.encode(odd_docs, vocab_path(), out="n_tokens")          # replaces the column of that name
    rows = out.collect()
    assert len(rows) == odd_docs.count() and set(out.columns) == set(odd_docs.columns)
    for r in rows:
        assert r.n_tokens == reference.encode(r.text or "", add_special_tokens=False).ids
    back = bpe.decode(out, vocab_path(), "n_tokens").collect()
    assert [r.decoded for r in back] == [reference.decode(r.n_tokens, skip_special_tokens=False) for r in rows]
    assert bpe.encode(no_docs, vocab_path()).count() == 0


def test_piece_counts_cover_all_texts(spark, odd_docs):
    vocab = bpe.vocabulary(vocab_path())
    expected = Counter(p for r in odd_docs.collect() if r.text for p in vocab.pieces(r.text))
    assert {r.piece: r.n for r in bpe.piece_counts(odd_docs, vocab_path()).collect()} == expected


def test_merges_of_blocks_equal_the_heap():
    vocab = bpe.vocabulary(vocab_path())
    rng = np.random.default_rng(1)
    words = [bytes(rng.integers(97, 110, rng.integers(1, 48)).astype(np.uint8)) for _ in range(300)]
    assert bpe.merge_words(vocab, words) == [bpe._merge_long(vocab, w) for w in words]


def test_slices_hold_all_rows_and_few_bytes():
    texts = ["x" * (i % 50) * 40 for i in range(3000)] + [None, ""]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    parts = list(slices(batch, 20_000))
    assert [t for b in parts for t in b.column(0).to_pylist()] == texts
    assert max(b.nbytes for b in parts) < 60_000
    assert [b.num_rows for b in slices(batch.slice(0, 0))] == [0]
    assert [b.num_rows for b in slices(batch.slice(0, 2), 1)] == [1, 1]


def test_columns_are_added_to_a_few_bytes_at_a_time(spark):
    docs = spark.range(4000).selectExpr("id", "repeat('word ', 500) as text").coalesce(1)      # 10 MB, one batch

    def make():
        def held(texts):
            return [[sum(map(len, texts))] * len(texts)]
        return held

    rows = add_columns(docs, ["text"], [T.StructField("held", T.LongType())], make).select("id", "held").collect()
    assert [r.id for r in rows] == list(range(4000))
    assert max(r.held for r in rows) <= SLICE_BYTES
