import random

import pandas as pd
from pyspark.sql import functions as F

from rivalry.operators.ranking import dense_index, row_number, running_sum


def _rows(n=400, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        # group "hot" holds about half of all rows
        g = "hot" if rnd.random() < 0.5 else f"g{rnd.randint(0, 9)}"
        rows.append((g, rnd.randint(0, 50), i, rnd.randint(1, 5)))
    return rows


def test_running_sum_matches_pandas(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "g string, v int, id int, w int")
    out = running_sum(df, ["g"], ["v", "id"], "w", out="cum", total="tot", chunks=7).toPandas()
    pdf = pd.DataFrame(rows, columns=["g", "v", "id", "w"]).sort_values(["g", "v", "id"])
    pdf["cum"] = pdf.groupby("g")["w"].cumsum()
    pdf["tot"] = pdf.groupby("g")["w"].transform("sum")
    m = out.merge(pdf, on=["g", "v", "id", "w"], suffixes=("", "_exp"))
    assert len(m) == len(rows)
    assert (m["cum"] == m["cum_exp"]).all()
    assert (m["tot"] == m["tot_exp"]).all()


def test_row_number_global_and_desc(spark):
    rows = [(i, (i * 37) % 101) for i in range(101)]
    df = spark.createDataFrame(rows, "id int, v int")
    out = row_number(df, [], [F.desc("v"), "id"], out="rn", chunks=5).orderBy("rn").collect()
    assert [r.rn for r in out] == list(range(1, 102))
    assert [r.v for r in out] == sorted((v for _, v in rows), reverse=True)


def test_dense_index_is_bijection(spark):
    df = spark.createDataFrame([(k,) for k in [5, 3, 3, 9, 5, 1, None]], "team bigint")
    out = {r.team: r.idx for r in dense_index(df, "team", chunks=3).collect()}
    assert out == {1: 0, 3: 1, 5: 2, 9: 3}


def test_hot_group_is_spread_over_slices(spark):
    # one group holds 75 % of all rows: it must not land in one slice / task
    rows = [("hot" if i % 4 else f"g{i % 13}", i) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, v int")
    out = running_sum(df, ["g"], ["v"], None, out="rn", chunks=8, slice_col="slice")
    hot = out.where("g = 'hot'")
    per_slice = {r.slice: r.n for r in hot.groupBy("slice").agg(F.count("*").alias("n")).collect()}
    assert len(per_slice) >= 5
    assert max(per_slice.values()) < 0.4 * hot.count()
    # and the numbering is still one contiguous 1..n over the whole group
    rn = sorted(r.rn for r in hot.select("rn").collect())
    assert rn == list(range(1, 3001))


def test_null_group_keeps_its_rows(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), ("a", 2)], "g string, v int")
    key = lambda t: (t[0] is not None, t[0] or "", t[1])
    got = sorted(((r.g, r.v, r.rn) for r in row_number(df, ["g"], ["v"], chunks=2).collect()), key=key)
    assert got == [(None, 1, 1), (None, 3, 2), ("a", 2, 1)]
