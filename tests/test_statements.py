from pyspark.sql import functions as F

from loreloom.functions.statements import statement_digest


def test_same_content_has_one_digest(spark):
    same = [
        ["Tall.", "Likes\tmaps"],
        ["likes maps", "tall."],
        ["TALL.", None, "  ", "Likes\u00a0Maps", "tall."],
        ["t a l l .", "likesmaps"],
    ]
    other = [["Tall"], ["tall.", "likes map"], None, []]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(same + other)], "i int, x array<string>")
    got = {r.i: r.d for r in rows.select("i", statement_digest(F.col("x")).alias("d")).collect()}
    assert len({got[i] for i in range(4)}) == 1
    assert got[4] not in {got[0], got[5]} and got[5] != got[0]
    assert got[6] == got[7] != got[0]


def test_two_arrays_do_not_run_into_each_other(spark):
    rows = spark.createDataFrame([(["a"], ["b"]), (["a", "b"], []), ([], ["a", "b"])], "x array<string>, y array<string>")
    assert len({r[0] for r in rows.select(statement_digest(F.col("x"), F.col("y"))).collect()}) == 3
