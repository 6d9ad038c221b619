import pytest
from pyspark.sql import functions as F

from memloom.llm import spans

TEXTS = [
    "One sentence here. Another one follows, with a clause. " * 6,
    "第一句话在这里。第二句话，带着从句！第三句？" * 9,
    "x" * 500, "👩‍👩‍👧‍👦é̈" * 40, "line\n\n" * 60, "- item one\n- item two\n" * 20, "\U0001f600" * 90, " " * 200, "a\tb " * 77, "", "short",
]


@pytest.mark.parametrize(("size", "overlap"), [(1, 0), (12, 3), (20, 19), (160, 24), (40, 0)])
def test_pieces_cover_and_overlap(spark, size, overlap):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "i int, t string")
    for r in df.select("i", "t", spans.pieces(F.col("t"), size, overlap).alias("p")).collect():
        if r.t is None or len(r.t) <= size:
            assert r.p is None
            continue
        end = 0
        for k, p in enumerate(r.p):
            assert p.text == r.t[p.start : p.end] and 0 < len(p.text) <= size
            assert p.start == (max(0, end - overlap) if k else 0) and p.end > end
            end = p.end
        assert end == len(r.t)


def test_cuts_at_the_strongest_boundary(spark):
    text = "First part ends here.\n\nThen more words, and so on until it is far too long to fit"
    got = spark.createDataFrame([(text,)], "t string").select(spans.pieces(F.col("t"), 30, 0).alias("p")).first().p
    assert got[0].text == "First part ends here.\n\n" and got[1].text.endswith(" ")


def test_long_text_and_bad_config(spark):
    big = "word " * 40_000
    got = spark.createDataFrame([(1, big)], "k int, t string")
    cut = spans.split_oversized(got, "t", [(1, 2000, 100), (2, 10**6, 0)], ["k"]).collect()
    assert [(r.config_id, r.pieces[-1].end) for r in cut] == [(1, len(big))]
    with pytest.raises(ValueError):
        spans.pieces(F.col("t"), 10, 10)
