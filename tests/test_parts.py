"""What a worker holds of a batch of texts."""

import tracemalloc

import pyarrow as pa

from statuta.functions import parts
from statuta.operators.chunking import chunk

KIND = pa.list_(pa.struct([("heading", pa.string()), ("content", pa.string()), ("kind", pa.string())]))


def cut(text):
    return [c._asdict() for c in chunk(text or "")]


def test_objects_follow_a_few_rows_not_the_batch():
    texts = pa.array(["một đoạn văn\n\n" * 600] * 4000)  # 8 million characters
    tracemalloc.start()
    got = parts.mapped(cut, KIND, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 4000 and peak < 8e6  # all of them at once are over 30 MB


def test_rows_keep_their_order_and_nulls():
    a, b = pa.array([None if i % 7 == 0 else i for i in range(200)]), pa.array(range(200, 400))
    assert parts.mapped(lambda x, y: None if x is None else x + y, pa.int64(), a, b).to_pylist() == [None if i % 7 == 0 else 2 * i + 200 for i in range(200)]
    assert parts.mapped(cut, KIND, pa.array([None, ""])).to_pylist() == [cut(None), cut("")]
    assert len(parts.mapped(cut, KIND, pa.array([], pa.string()))) == 0
