import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from glintdex.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def padding(pieces):
    """Padding of all sequences, which must have no gap and no overlap."""
    sequences = defaultdict(list)
    for length, sequence, offset in pieces:
        sequences[sequence].append((offset, length))
    total = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert 0 < at <= 2048
        total += 0 if at & (at - 1) == 0 else 2048 - at
    return total


@pytest.mark.parametrize("counts", [{}, {1: 1}, {2047: 5}, {1500: 40}, {700: 9, 648: 9, 1: 3}, dict(Counter(np.random.default_rng(1).integers(1, 2048, 3000).tolist()))])
def test_every_remainder_has_its_place(counts):
    plan = packing.plan(counts, 2048)
    pieces = []
    for length, n in counts.items():
        for rank in range(n):
            own = plan.pieces(length, rank)
            assert sum(p[0] for p in own) == length
            pieces += own
    assert padding(pieces) == 0
    assert {p[1] for p in pieces} == set(range(plan.sequences))


def test_program_is_near_its_least():
    counts = Counter(np.random.default_rng(2).integers(20, 2048, 4000).tolist())
    lengths = np.array(sorted(counts))
    demand = np.array([counts[x] for x in lengths], float)
    columns, times = packing.patterns(lengths, demand, 2048)
    assert np.allclose(columns @ times, demand)
    assert (lengths @ columns <= 2048).all()
    assert times.sum() <= 1.01 * (lengths @ demand) / 2048


def test_knapsack_against_every_multiset():
    lengths, price = np.array([3, 5, 7]), np.array([0.31, 0.52, 0.75])
    best = max(a * 0.31 + b * 0.52 + c * 0.75 for a in range(7) for b in range(5) for c in range(4) if 3 * a + 5 * b + 7 * c <= 20)
    value, column = packing.best_pattern(lengths, price, 20)
    assert value == pytest.approx(best)
    assert column @ price == pytest.approx(best)


def test_documents(spark):
    texts = ["word " * 5000, None, "", "a b c", "a b c", "longer text here " * 400] + [f"doc {i} " * (i % 40) for i in range(150)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(3, "a b c", 0)], "doc_id long, text string, length int")
    rows = packing.digests(docs, PATH).collect()
    library = Tokenizer.from_file(PATH)
    own = defaultdict(list)
    for r in rows:
        own[r["doc_id"]].append(r)
    assert set(own) == set(range(len(texts)))
    for i, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        copies = 2 if i == 3 else 1
        assert sum(r["length"] for r in own[i]) == copies * len(ids)
        for r in own[i]:
            assert r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    assert padding([(r["length"], r["sequence_id"], r["offset"]) for r in rows]) == 0
    assert packing.digests(docs.where("false"), PATH).count() == 0
