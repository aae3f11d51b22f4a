"""Counts that 32 bits don't hold."""

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import counting


@pytest.mark.parametrize("each", [3_000_000_000, (1 << 32) - 1, 1 << 33])
def test_counts_beyond_32_bits_are_exact(spark, each):
    class Heavy(np.ndarray):
        """Keys of which one stands for many: np.unique counts it ``each`` times."""

        def __array_function__(self, func, types, args, kwargs):
            out = func(*[np.asarray(a) for a in args], **kwargs)
            return (out[0], np.where(out[0] == out[0].max(), out[1] * each, out[1])) if kwargs.get("return_counts") else out

    key = np.array([1 << 20, 1 << 60], np.uint64)

    def keys_of(part):
        return np.repeat(key, len(part.id)).view(Heavy)

    def use(part, look_up):
        rare, frequent = look_up(key)
        return pa.table({"doc_id": pa.array(part.id), "rare": pa.array([int(rare)] * len(part.id)), "frequent": pa.array([int(frequent)] * len(part.id))})

    docs = spark.createDataFrame([(i, "word") for i in range(20)], "doc_id long, text string")
    got = {(r.rare, r.frequent) for r in counting.with_counts(docs, keys_of, use, "doc_id long, rare long, frequent long").collect()}
    assert got == {(20, 20 * each)}
