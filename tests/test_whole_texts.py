from difflib import SequenceMatcher

from tallyloom.plans import catalog

START = " ".join(f"word{i}" for i in range(60))


def best(a, b):
    """Of the texts and of their sorted words; these texts are their own normal form."""
    sort = lambda t: " ".join(sorted(t.split()))
    return round(max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, sort(a), sort(b)).ratio()), 6)


def test_whole_documents_are_compared(spark, tmp_path):
    texts = [START + " x" * 400, START + " other ends here" * 30, START + " other ends here" * 30]
    assert len(START) > 200
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.similarity for r in catalog.text_similarity(spark, str(tmp_path)).collect()}
    assert got == {0: best(texts[0], texts[1]), 1: 1.0} and got[0] < 1


def test_whole_messages_are_compared(spark, tmp_path):
    a, b = START + " x" * 100, START + " other ends"
    rows = [(1, 0, "user", a), (1, 1, "assistant", b), (1, 2, "user", "abc"), (1, 3, "assistant", "abd")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = catalog.warnings_compare(spark, str(tmp_path)).first()["similarity"]
    assert got == best("abc\n" + a, "abd\n" + b) < 1
