from pyspark.sql import functions as F

from sieveline.operators.evaluate import _place, vocabulary_ids

LEAST, MOST = -(2**63), 2**63 - 1


def test_first_places_without_a_sort(spark):
    """Ties go by the first place, nulls first, at the ends of the types too; hashing finds it, no sort of all tokens."""
    rows = [(MOST, 0, "g"), (0, 2**31 - 1, "f"), (0, 5, "e"), (0, -(2**31), "d"), (-1, 9, "c"), (LEAST, 1, "b"), (None, 3, "a"), (7, 7, "a"), (8, None, "h"), (8, 0, "i")]
    tokens = spark.createDataFrame(rows, "doc long, pos int, token string")
    found = vocabulary_ids(tokens, "token", ["doc", "pos"])
    assert [(r.token, r.n, r.id) for r in found.orderBy("id").collect()] == [(t, 2 if t == "a" else 1, i) for i, t in enumerate("abcdefhig", 2)]
    plan = lambda place: tokens.groupBy("token").agg(F.min(place))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" in plan(F.struct("doc", "pos")) and "SortAggregate" not in plan(_place(tokens, ["doc", "pos"]))


def test_places_of_other_types_stay_structs(spark):
    tokens = spark.createDataFrame([("b", 1, "x"), ("a", 2, "y")], "doc string, pos int, token string")
    assert [r.token for r in vocabulary_ids(tokens, "token", ["doc", "pos"]).orderBy("id").collect()] == ["y", "x"]
