from difflib import SequenceMatcher

from tallyloom.functions.markup import dom_tokens
from tallyloom.plans import catalog


def test_whole_pages_are_compared(spark, tmp_path):
    start = "".join(f"<p class='c{i}'>text {i}</p>" for i in range(100))
    pages = [start + "<div>one</div>" * 50, start + "<ul><li>other</li></ul>" * 40, start + "<ul><li>other</li></ul>" * 40]
    assert len(start) > 1500
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r.similarity for r in catalog.html_similarity(spark, str(tmp_path)).collect()}
    want = round(SequenceMatcher(None, dom_tokens(pages[0]), dom_tokens(pages[1])).ratio(), 6)
    assert got == {0: want, 1: 1.0} and want < 1
