"""Stupid-backoff scores of documents under n-gram counts of the whole corpus.

N-grams of one to three words are counted over all documents, by hash, and joined back to each document's
n-grams. A word scores count(n-gram) / count(its history) where the n-gram was counted ``min_count``
times or more; else ``backoff`` times its score under the history less its first word; a single word
scores its share of all words. A document's score is the sum of the logarithms.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Defined results: a null text, or one without
words, has 0 words, a score of 0 and no mean. Repeated rows count, and are scored, each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .counting import NULL_ID, Part, with_counts

ORDER = 3
BACKOFF = 0.4
MIN_COUNT = 2


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", backoff: float = BACKOFF, min_count: int = MIN_COUNT, order: int = ORDER, bits: int = 56) -> DataFrame:
    """``doc_id, n_words, log_score, mean_log_score, seen_share``; seen_share is the share of words whose longest n-gram was counted."""
    total_key = np.array([0x5851F42D4C957F2D], np.uint64)

    def keys_of(part: Part) -> np.ndarray:
        w = part.words
        out = [np.repeat(total_key, len(w.hash))]  # as often as there are words: its count is the corpus size
        for n in range(1, order + 1):
            h = w.chained(n)
            out.append(h[w.text[: len(h)] == w.text[n - 1 :]] if len(h) else h)
        return np.concatenate(out)

    def use(part: Part, look_up) -> pa.Table:
        w = part.words
        n_docs, n = len(part.id), len(w.hash)
        place = np.arange(n) - w.first[w.text]  # of a word in its text
        counts = []
        for k in range(1, order + 1):
            c = np.zeros(n, np.int64)
            h = w.chained(k)
            ok = np.flatnonzero(place >= k - 1)
            c[ok] = look_up(h[ok - (k - 1)])
            counts.append(c)  # of the k-gram that ends here
        logs = np.zeros(n)
        if n:
            with np.errstate(divide="ignore", invalid="ignore"):
                value = np.log(counts[0] / look_up(total_key)[0])
                for k in range(2, order + 1):
                    before = np.concatenate(([1], counts[k - 2][:-1]))
                    seen = (counts[k - 1] >= min_count) & (place >= k - 1)
                    longer = np.log(counts[k - 1] / before)
                    value = np.where(seen, longer, np.where(place >= k - 1, value + np.log(backoff), value))
            logs = value
        seen = (counts[-1] >= min_count) & (place >= order - 1) if n else np.zeros(0, bool)
        summed, words, found = (np.bincount(w.text, x, minlength=n_docs) if n else np.zeros(n_docs) for x in (logs, np.ones(n), seen))
        blank = words == 0
        each = lambda x: pa.array(np.where(blank, 0, x / np.maximum(words, 1)), mask=blank)
        return pa.table([pa.array(part.id, mask=part.id == NULL_ID), pa.array(words.astype(np.int64)), pa.array(summed), each(summed), each(found)], names=["doc_id", "n_words", "log_score", "mean_log_score", "seen_share"])

    return with_counts(df, keys_of, use, "doc_id long, n_words long, log_score double, mean_log_score double, seen_share double", id_col, text_col, bits)
