import tempfile

from rivalry.sources import schemas
from rivalry.sources.files import read_targets, write_submission


def test_submission_csv_round_trip(spark):
    df = spark.createDataFrame([("2000_1_2", 0.25), ("2000_1_3", 0.75)], schemas.SUBMISSION)
    path = tempfile.mkdtemp(prefix="rivalry-sub-", dir="/tmp") + "/sub"
    write_submission(df, path)
    back = read_targets(spark, path)
    assert [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in schemas.TARGETS]
    assert sorted(tuple(r) for r in back.collect()) == [("2000_1_2", 0.25), ("2000_1_3", 0.75)]


def test_csv_columns_matched_by_name_not_position(spark):
    from rivalry.sources.files import read_season_contests
    path = tempfile.mkdtemp(prefix="rivalry-csv-", dir="/tmp") + "/full.csv"
    with open(path, "w") as f:
        f.write("Season,DayNum,LTeamID,WScore,WTeamID,LScore\n2003,10,1104,68,1328,62\n")
    r = read_season_contests(spark, path).collect()
    assert [tuple(x) for x in r] == [(1328, 1104)]


def test_null_key_fails_loudly(spark):
    import pytest
    from rivalry.sources.files import read_season_contests
    path = tempfile.mkdtemp(prefix="rivalry-csv-", dir="/tmp") + "/bad.csv"
    with open(path, "w") as f:
        f.write("WTeamID,LTeamID\n1,2\n,3\n")
    with pytest.raises(Exception, match="NULL in key column WTeamID"):
        read_season_contests(spark, path).collect()


def test_parquet_input_is_projected_and_cast(spark):
    from rivalry.sources.files import read_contests
    path = tempfile.mkdtemp(prefix="rivalry-pq-", dir="/tmp") + "/c"
    spark.createDataFrame([(2003, 10, 1328, 68, 1104, 62, "N", 0, 99)],
                          "Season long, DayNum int, WTeamID int, WScore int, LTeamID int, LScore int, "
                          "WLoc string, NumOT int, Extra int").write.parquet(path)
    df = read_contests(spark, path, fmt="parquet")
    assert [(f.name, f.dataType.simpleString()) for f in df.schema] == [
        ("Season", "int"), ("WTeamID", "bigint"), ("WScore", "double"), ("LTeamID", "bigint"),
        ("LScore", "double"), ("WLoc", "string"), ("NumOT", "int")]
    assert tuple(df.collect()[0]) == (2003, 1328, 68.0, 1104, 62.0, "N", 0)


def _two_files(first, second):
    folder = tempfile.mkdtemp(prefix="rivalry-csv2-", dir="/tmp")
    for name, text in (("a.csv", first), ("b.csv", second)):
        with open(f"{folder}/{name}", "w") as f:
            f.write(text)
    return folder


def test_files_with_another_header_order_fail(spark):
    import pytest
    from rivalry.sources.files import read_season_contests
    folder = _two_files("WTeamID,LTeamID\n9,8\n", "LTeamID,WTeamID\n9,8\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_season_contests(spark, folder).collect()
    same = _two_files("WTeamID,LTeamID\n9,8\n", "WTeamID,LTeamID\n7,6\n")
    assert sorted(map(tuple, read_season_contests(spark, same).collect())) == [(7, 6), (9, 8)]


def test_stream_with_another_header_order_fails(spark):
    import pytest
    from rivalry.streaming.scoring import read_request_stream
    folder = _two_files("ID,Pred\n2000_1_2,0.5\n", "Pred,ID\n0.5,2000_1_3\n")
    q = read_request_stream(spark, folder).writeStream.format("memory").queryName("swapped").start()
    with pytest.raises(Exception, match="FAILED_READ_FILE.*b.csv"):
        q.processAllAvailable()
