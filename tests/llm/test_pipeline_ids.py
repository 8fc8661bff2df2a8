import collections

import corpus_pipeline


def text(start):
    return " ".join(f"word{i}" for i in range(start, start + 60))


def kept(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return collections.Counter((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())


def test_texts_that_share_an_id_all_stay(spark):
    assert kept(spark, [(1, text(0)), (1, text(1000)), (2, text(0))]) == {(1, text(0)): 1, (1, text(1000)): 1}


def test_a_copy_goes_though_its_id_stays(spark):
    assert kept(spark, [(1, text(0)), (2, text(0)), (2, text(1000))]) == {(1, text(0)): 1, (2, text(1000)): 1}


def test_copies_without_an_id_go(spark):
    rows = [(1, text(0)), (None, text(0)), (None, text(1000)), (None, text(1000)), (None, text(2000))]
    assert kept(spark, rows) == {(1, text(0)): 1, (None, text(1000)): 1, (None, text(2000)): 1}
