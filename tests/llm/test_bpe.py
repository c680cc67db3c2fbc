import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from glintdex.llm import bpe
from glintdex.llm.words import library_ids

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "b", " ", "\n", "'", "s", "'s", "'LL", "<|endoftext|>", "<|", "É", "ß", "İ", "Σ", "ς", "ﬁ", "²", "٣", "中", "e\u0301", "\x85", "\xa0", "\x1c", "🙂", "!!", "_", "ing", "the", "aaaa", "ŉ", "Å", "\x00", "ู", "“", "0"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def cases():
    rng = random.Random(4)
    made = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    return [*made, "", "word " * 20_000, "x" * 3000, "ab" * 2000]


def test_same_as_library(library):
    codec, ids = bpe.codec(PATH), library_ids(PATH)
    for text in cases():
        want = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == want, text[:50]
        assert np.frombuffer(ids.encode(text), "<u4").tolist() == want
        assert codec.decode(want) == library.decode(want, skip_special_tokens=False)


def test_vocabulary_joined(library):
    codec = bpe.codec(PATH)
    rng = random.Random(5)
    own = [t.removesuffix("</w>") for t in codec.tokens if t.isascii()]
    for _ in range(3000):
        text = "".join(rng.choice(own) for _ in range(rng.randint(1, 4)))
        assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_documents(spark, library):
    rows = [(1, "Hello wörld", "x"), (2, None, None), (3, "", "y"), (1, "Hello wörld", "x"), (None, "a", "z"), (4, "long " * 50_000, "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.digests(docs, PATH).collect()
    assert len(got) == len(rows)
    for doc_id, text, _ in rows:
        want = library.encode(text or "", add_special_tokens=False).ids
        row = next(r for r in got if r["doc_id"] == doc_id)
        assert row["n_tokens"] == len(want)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digests(docs.where("false"), PATH).count() == 0
