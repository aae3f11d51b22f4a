"""Stages on rows whose ids are null or repeated, and takes of repeated ids."""

import corpus_pipeline as cp

from tidemark.llm import mixing

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def test_join_stage_keeps_one_of_each(spark, sf):
    a, b = "one two three four five six seven", "completely other words are standing here now"
    rows = [(None, a), (None, a), (None, b), (None, b + " again"), (3, a), (3, "alone in this text with id three"), (4, "alone in this text with id three"), (5, None), (5, None), (None, ""), (6, b)]
    df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], DDL)
    got = sorted(((r.doc_id, r.text) for r in cp.near_duplicate_stage(spark, df, sf).collect()), key=repr)
    texts = [t for _, t in got]
    assert texts.count(a) == 1 and (None, a) in got
    assert sum(t in (b, b + " again") for t in texts) in (1, 2) and (6, b) not in got
    assert (3, "alone in this text with id three") in got and (4, "alone in this text with id three") not in got
    assert texts.count(None) == 2 and texts.count("") == 1


def test_quality_stage_judges_rows_not_ids(spark, sf):
    good = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1"), "doc_id").orderBy("doc_id").limit(30).collect()
    rows = [(None, r.text, r.lang, r.source, r.n_chars) for r in good] + [(None, "|| ## @@ 0 0 0 0 0 !!!! " * 30, "en", "s", 5)] * 3
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*cp.COLUMNS)
    got = cp.quality_stage(spark, docs.unionByName(spark.createDataFrame(rows, DDL)), sf).where("doc_id is null").collect()
    assert not any(r.text.startswith("||") for r in got) and len(got) >= 25


def test_takes_of_repeated_ids(spark):
    rows = [(1, "a b c d"), (1, "x y"), (None, "p q r"), (None, "s"), (2, "z z"), (2, "z z")]
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], DDL)
    plan = spark.createDataFrame([(1, 2, 1), (1, 4, 8), (None, 3, 0), (None, 1, 3), (2, 2, 0), (2, 2, 2)], "doc_id long, size long, taken long")
    got = sorted(((r.doc_id, r.text) for r in mixing.taken_rows(df, plan).collect()), key=repr)
    assert got == sorted([(1, "x"), (1, "a b c d"), (1, "a b c d"), (None, "s"), (None, "s"), (None, "s"), (2, "z z")], key=repr)


def test_mixing_stage_meets_its_plan(spark, sf):
    rows = [(None if k % 3 else k % 7, "w%d " % (k % 5) * (1 + k % 9), "en", "ab"[k % 2], 1) for k in range(400)]
    df = spark.createDataFrame(rows, DDL)
    want = mixing.mix(cp.keyed(df), id_col="_row").agg({"taken": "sum"}).first()[0]
    assert sum(len(r.text.split()) for r in cp.mixing_stage(spark, df, sf).collect()) == want
