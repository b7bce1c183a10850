"""What a Python worker holds at once, over what it was given and what it returns."""

import tracemalloc

import numpy as np
import pyarrow as pa
import public_tokenizers

from tellurion.llm import encoding, packing, substring

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def texts(n, n_words=1000, vocabulary=3000):
    draw = np.random.default_rng(4)
    return [" ".join(f"w{x}" for x in draw.integers(0, vocabulary, n_words)) for _ in range(n)]


def most_held(f):
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_windows_of_a_home_are_named_in_parts():
    own = pa.table({"row": pa.array([{"doc_id": i, "text": t} for i, t in enumerate(texts(1100))]), "ord": np.arange(1100)})
    found = pa.table({"keys": [np.arange(1, 9, dtype="<u8").tobytes()], "checks": [np.zeros(8, "<u4").tobytes()], "ids": [np.zeros(8, "<i8").tobytes()]})
    assert 5e6 < sum(map(len, own["row"].combine_chunks().field("text").to_pylist())) < 7e6

    def run():
        for part in substring._keep_words(own, found, 13, 2):
            del part

    assert most_held(run) < 70


def test_what_a_shard_received_is_ordered_column_by_column():
    draw = np.random.default_rng(6)
    n, each, homes = 200_000, 1000, 8
    sent = []
    for home in range(homes):
        key = np.sort(draw.integers(0, 2**63, n, dtype=np.uint64))
        packed = substring._packed(home, 1, key, np.zeros(n, "<u4"), draw.integers(0, each, n))
        sent += packed.to_batches()
    assert most_held(lambda: substring._received(iter(sent))) < 100
    home, key, check, ids, more, first = substring._received(iter(sent))
    assert len(key) == n * homes and (key[1:] >= key[:-1]).all() and np.bincount(home).tolist() == [n] * homes


def test_pieces_are_cut_in_parts():
    own = texts(1100)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(own))), pa.array(own)], ["doc_id", "text"])
    for _ in encoding.encoded(TOKENIZER, iter([batch.slice(0, 100)]), "text"):
        pass  # the worker's tables are there

    def run():
        for part in packing.cut_up(iter([batch]), TOKENIZER, 2048, 0, True, 0):
            del part

    assert most_held(run) < 40
