"""Query op2: digests of the encoded and decoded texts of ``documents``."""
from __future__ import annotations

from hashlib import sha256

from pyspark.sql import types as T

from hazardlake.llm import bpe
from hazardlake.llm.common import add_columns, table


def vocab_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = vocab_path()
    lexicon = bpe.build_lexicon(docs, path)

    def make():
        enc = bpe.encoder(path, lexicon)
        number = list(map(str, range(len(enc.vocab.tokens))))

        def digests(texts):
            n, ids_hex, text_hex = [], [], []
            for ids in enc.encode(texts):
                n.append(len(ids))
                ids_hex.append(sha256(" ".join(map(number.__getitem__, ids)).encode()).hexdigest())
                text_hex.append(sha256(enc.decode(ids).encode()).hexdigest())
            return [n, ids_hex, text_hex]
        return digests

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
              T.StructField("decoded_sha256", T.StringType())]
    return add_columns(docs, ["text"], fields, make).drop("text")
