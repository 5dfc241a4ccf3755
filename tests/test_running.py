import random

from pyspark.sql import functions as F

from loreloom.operators import running
from loreloom.operators.running import running_sum


def test_running_sum_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(running, "BLOCK_BITS", 2)
    rng = random.Random(4)
    rows = [(g, o, rng.choice([None, 0, 1, 5])) for g in "ab" for o in rng.sample(range(-50, 50), 40)]
    df = spark.createDataFrame(rows, "g string, o int, v int")
    for sign in (1, -1):
        got = {(r.g, r.o): r.total for r in running_sum(df, ["g"], F.col("o") * sign, F.col("v"), "total").collect()}
        assert got == {(g, o): sum((v or 0) for h, p, v in rows if h == g and p * sign <= o * sign) for g, o, _ in rows}
    assert running_sum(df.limit(0), ["g"], F.col("o"), F.col("v"), "total").count() == 0
