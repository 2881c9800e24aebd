"""Rows picked by number without a shuffle of their texts."""

from collections import Counter

from tidemark.llm.common import among


def test_rows_among_numbers(spark):
    """Numbers at the borders of words and kilobytes, negative, far apart, repeated and none; texts aren't shuffled."""
    numbers = [0, 1, 63, 64, 8191, 8192, 8193, -1, -64, -65, (5 << 33) + 7, (1 << 62), None]
    rows = spark.createDataFrame([(n, f"t{n}") for n in numbers], "n long, text string")
    for wanted in ([], [0], [63, 63, 8192, None], [-1, -65, (5 << 33) + 7], [1 << 62, 64, 2]):
        picked = spark.createDataFrame([(n,) for n in wanted], "w long")
        have = {w for w in wanted if w is not None}
        assert {r.n for r in among(rows, "n", picked).collect()} == {n for n in numbers if n in have}
        assert Counter(r.n for r in among(rows, "n", picked, there=False).collect()) == Counter(n for n in numbers if n not in have)
    assert "SortMergeJoin" not in among(rows, "n", picked)._jdf.queryExecution().executedPlan().toString()
