"""Members of a large group at exactly the limit."""

from geomill.llm import neardup


def test_prefix_holds_the_common_gram_at_the_limit(spark):
    # 80 shingles inside 100, similarity 0.8: both differ from the common set in grams 20 to 24, the smaller in 0 to 19 too
    rows = [(1, 2, 80, 25, g) for g in range(25)] + [(1, 3, 100, 5, g) for g in range(20, 25)]
    diff = spark.createDataFrame(rows, "p long, id long, size long, diff long, gram long")
    labels = spark.createDataFrame([], "node long, label long")
    assert {tuple(r) for r in neardup._large_pairs(diff, labels, 0.8).collect()} == {(2, 3)}
