import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import prefix_forest
from tidemark.llm.common import components, pack_columns, pack_sorted, unpack_columns, unpack_sorted


def brute(ids, x, q, k):
    s = (x * x[q]).sum(1)
    ok = ids != ids[q]
    best = np.lexsort((ids[ok], -s[ok]))[:k]
    return ids[ok][best]


@pytest.mark.parametrize("blocks", [16_384, 120])
def test_recall(spark, sf, blocks):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = df.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    got = {}
    for r in prefix_forest.search(df, block_rows=blocks).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        own = sorted(got[ids[q]])
        assert [r for r, _, _ in own] == list(range(1, 21)) and [(-s, i) for _, i, s in own] == sorted((-s, i) for _, i, s in own)
        assert all(abs(s - x[q] @ x[np.flatnonzero(ids == i)[0]]) < 1e-12 for _, i, s in own)
        hits += len({i for _, i, _ in own} & set(brute(ids, x, q, 20).tolist()))
    assert hits / (20 * len(got)) >= 0.9


def test_odd_vectors(spark):
    good = [(k, [1.0, k % 3 + 0.5, -1.0]) for k in range(0, 60)]
    odd = [(100, None), (120, [0.0, 0.0, 0.0]), (140, [1.0, None, 2.0]), (160, [float("nan"), 1.0, 1.0]), (180, [float("inf"), 1.0, 1.0]), (200, []), (220, [1.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(good + odd, "vec_id long, embedding array<float>").withColumn("query", F.lit(1)).withColumn("v", F.lit(2))
    got = prefix_forest.search(df).collect()
    assert {r.query_id for r in got} == {0, 20, 40}  # 220 is alone in its length
    of_0 = [r for r in got if r.query_id == 0]
    same = sorted(k for k, _ in good if k % 3 == 2)
    assert [r.vec_id for r in sorted(of_0, key=lambda r: r["rank"])] == same[:20]
    assert prefix_forest.search(df.where("false")).count() == 0
    assert prefix_forest.search(df.where("vec_id in (0, 1, 2)")).count() == 2


def test_many_copies_do_not_hide_others(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [1.0, 0.0, 0.0]) for k in range(2000)] + [(3000 + k, rng.normal(size=3).tolist()) for k in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in prefix_forest.search(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    recall = np.mean([len({i for _, i in v} & set(brute(ids, x, int(np.flatnonzero(ids == q)[0]), 20).tolist())) / 20 for q, v in got.items()])
    assert recall >= 0.9


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1040)]
    up = {}

    def top(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in pairs:
        if a != b:
            up[max(top(a), top(b))] = min(top(a), top(b))
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: top(i) for i in up}


def test_packing_of_columns():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (unpack_sorted(pack_sorted(keys)) == keys).all() and len(unpack_sorted(pack_sorted(keys[:0]))) == 0
    a, b = rng.integers(-9, 9, 50), rng.integers(0, 255, 50).astype(np.uint8)
    x, y = unpack_columns(pack_columns(a, b), (np.int64, np.uint8))
    assert (x == a).all() and (y == b).all()


def test_pipeline(spark, sf, tmp_path):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(docs.count())
        if k < len(cp.STAGES) - 1:
            assert docs.columns == cp.COLUMNS
        if k == 0:
            labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1")
            lost = before.join(labels, "doc_id", "left_semi").join(docs, "doc_id", "left_anti").count()
            assert lost <= 0.05 * labels.count()
        if k == 1:
            from tidemark.llm import ngram_join

            assert ngram_join.join(docs).where("doc_id <> component_id").count() == 0
        if k == 2:
            from tidemark.llm import suffix_dedup

            want = {r.doc_id: r.kept.decode("utf-8", "ignore") for r in suffix_dedup.dedup(before, with_kept=True).collect()}
            assert {r.doc_id: r.text for r in docs.collect()} == want
    assert counts[0] > counts[1] > counts[2] == counts[3] and counts[5] >= counts[4] > 0
    assert docs.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 4096


def test_stages_take_odd_rows(spark, sf):
    import corpus_pipeline as cp

    rows = [(0, None, None, None, None), (1, "", "en", "s", 0), (2, "word", None, None, 4), (None, "no id here", "en", "s", 10), (3, "ñé " * 400, "es", "s", 1200), (4, "ñé " * 400, "es", "s", 1200), (2, "word", None, None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in cp.STAGES:
        assert stage(spark, df, sf).count() > 0, name
        assert stage(spark, df.where("false"), sf).count() == 0, name


def test_sql_matches(spark, sf):
    import duckdb

    from tidemark.llm import queries

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, sf)
        cols = sorted(df.columns)
        cur = con.execute(sql)
        at = [[d[0] for d in cur.description].index(c) for c in cols]
        plain = lambda v: round(v, 5) if isinstance(v, float) else v
        assert sorted([[plain(r[c]) for c in cols] for r in df.collect()], key=repr) == sorted([[plain(r[i]) for i in at] for r in cur.fetchall()], key=repr), name
