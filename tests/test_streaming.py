import os
import tempfile


from rivalry.plans import catalog
from rivalry.streaming.scoring import CompletionTables, complete_stream, read_request_stream, start_scoring
from tests.conftest import SF_SMALL


def test_streamed_requests_match_batch_completion(spark):
    t = catalog._t(spark, SF_SMALL)
    sub = catalog._stand_in_sub(t)
    tables = CompletionTables(sub)
    batch = {}
    for r in catalog.q_fallback_prediction(spark, SF_SMALL).collect():
        batch.setdefault(r.ID, []).append(r.Pred)

    root = tempfile.mkdtemp(prefix="rivalry-stream-", dir="/tmp")
    inbox = os.path.join(root, "in")
    targets = t.targets.select("ID", "Pred")
    # two files arriving one after the other
    first, second = targets.randomSplit([0.5, 0.5], seed=1)
    first.coalesce(1).write.option("header", True).csv(os.path.join(inbox, "a"))
    q = start_scoring(read_request_stream(spark, os.path.join(inbox, "*")), tables,
                      os.path.join(root, "out"), os.path.join(root, "ckpt"))
    q.processAllAvailable()
    second.coalesce(1).write.option("header", True).csv(os.path.join(inbox, "b"))
    q.processAllAvailable()
    q.stop()
    streamed = {}
    for r in spark.read.parquet(os.path.join(root, "out")).collect():
        streamed.setdefault(r.ID, []).append(r.Pred)
    assert set(streamed) == set(batch)
    for k, vals in batch.items():                   # same multiset per request (repeat meetings)
        got = sorted(streamed[k])
        assert len(got) == len(vals)
        assert all(abs(a - b) < 1e-6 for a, b in zip(got, sorted(vals)))


def test_unknown_team_gets_default(spark):
    t = catalog._t(spark, SF_SMALL)
    tables = CompletionTables(catalog._stand_in_sub(t))
    req = spark.createDataFrame([("1999_999999_1000000", 0.5)], "ID string, Pred double")
    assert complete_stream(req, tables).collect()[0].Pred == 0.25
