import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from foliant.llm import best_fit_packing as B
from foliant.llm.tokens import encoder, vocabulary_path

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def plain_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [0]


@given(st.text(alphabet=st.sampled_from("ab '\n\t 1é日\x1c\x85\xa0　²!sret<|endoftext|>"), max_size=40) | st.text(max_size=30))
@settings(max_examples=400, deadline=None)
def test_ids_are_the_library_s(text):
    assert list(np.frombuffer(encoder(vocabulary_path()).ids(text), "<u4")) == LIBRARY.encode(text, add_special_tokens=False).ids


def check_packing(rows, out, capacity):
    want = []
    for doc, text in rows:
        ids = plain_ids(text)
        at, size, k = 0, len(ids) % capacity or capacity, 0
        while at < len(ids):
            want.append((doc, k, at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes())))
            at, size, k = at + size, capacity, k + 1
    assert sorted((tuple(r)[:5] for r in out), key=repr) == sorted(want, key=repr)
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_documents_round_trip(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [(1, None), (1, None), (None, "a b"), (2, ""), (3, "<|endoftext|> x"), (4, "word " * 9000)]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, rank int, length string")
    for capacity in (2048, 64):
        out = B.pack(df, capacity).collect()
        n = check_packing(rows, out, capacity)
        assert n <= 1.02 * sum(r.length for r in out) / capacity + 1
    assert B.pack(df.limit(0)).collect() == []


def exact(sizes, capacity):
    """The least number of sequences, by trying all places."""
    best = [len(sizes)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= sizes[i] and rooms[j] not in rooms[:j]:
                place(i + 1, rooms[:j] + [rooms[j] - sizes[i]] + rooms[j + 1 :])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best[0]


def test_reduction_loses_nothing():
    rng = random.Random(4)
    for _ in range(150):
        capacity = rng.randrange(6, 20)
        sizes = sorted((rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 9))), reverse=True)
        counts = np.bincount(sizes, minlength=capacity + 1)
        fixed, left = B.reduce_instance(counts, capacity)
        rest = [s for s in range(capacity, 0, -1) for _ in range(left[s])]
        assert sum(n for _, n in fixed) + exact(rest, capacity) == exact(sizes, capacity)
        plan = B.solve(counts, capacity)
        used = np.zeros(capacity + 1, int)
        for lengths, n in plan:
            assert sum(lengths) <= capacity
            used += np.bincount(lengths, minlength=capacity + 1) * n
        assert (used == counts).all()
