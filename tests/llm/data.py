"""Small document tables with every awkward case."""

import random

from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Beside the columns of ``documents`` some that clash with the operators' own.
CLASH = ("_h", "_fp", "rank", "block", "size", "shard", "slot", "score", "kept", "n_words", "_c0", "words", "Target")
SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()),
                     StructField("lang", StringType()), StructField("source", StringType()),
                     StructField("n_chars", LongType()), *[StructField(c, StringType()) for c in CLASH]])
WORDS = ("the and of to in is that it for was with by on house river stone winter light paper garden morning silver "
         "window forest bridge letter copper summer harbour valley market").split()


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def rows():
    rnd = random.Random(3)
    out = [(i, prose(rnd, rnd.randint(30, 160)), "en", f"s{i % 4}") for i in range(40)]
    near = prose(rnd, 150)
    out += [(100 + i, near, "en", "s0") for i in range(5)]
    out += [(110, near + " finally", "en", "s1"), (111, near.upper(), "en", None)]
    out += [(200, None, None, "s2"), (201, "", "en", "s2"), (202, " \t\n ", "en", None), (203, "one", "en", "s3"),
            (None, prose(rnd, 60), "en", "s3"), (None, None, None, None)]
    out += [(300, "the end of it\n" * 40, "en", "s1"), (301, "x### " * 80, "en", "s1"), (302, "WE SHOUT LOUD!! " * 30, "en", "s2"),
            (303, "héllo wörld ça été über straße naïve " * 20 + "　 中文 text <|endoftext|> é", "fr", "s0"),
            (304, prose(rnd, 9000), "en", "s3")]
    out += [(400, out[0][1], "en", "s0")] * 3          # whole rows repeated
    return [(i, t, la, s, None if t is None else len(t), *["x"] * len(CLASH)) for i, t, la, s in out]


def table(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA)


def write(spark, folder, some=None):
    table(spark, some).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    return folder


def duck(folder, sql, names=("documents",)):
    import duckdb
    con = duckdb.connect()
    for n in names:
        con.sql(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{folder}/{n}.parquet/*.parquet')")
    r = con.sql(sql)
    return r.columns, sorted(r.fetchall(), key=repr)


def same(df, found):
    columns, expected = found
    got = sorted(map(tuple, df.select(*columns).collect()), key=repr)
    assert got == expected
