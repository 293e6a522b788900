from datetime import datetime

from tidemark.llm import url_filter as uf

CAPTURES = "page_id long, url string, fetched timestamp_ntz"
CHANGES = "pattern string, verdict string, change string, at timestamp_ntz"


def day(text):
    return datetime.fromisoformat(text)


def judged(spark, captures, changes):
    out = uf.judge(spark.createDataFrame(captures, CAPTURES), spark.createDataFrame(changes, CHANGES))
    return {(r["page_id"], r["fetched"]): (r["blocked"], r["entry"]) for r in out.collect()}


def test_entries_hold_between_their_changes(spark):
    changes = [
        ("bad.example", "block", "add", day("2024-01-10")), ("bad.example", "block", "remove", day("2024-03-01")),
        ("bad.example", "block", "add", day("2024-05-01")), ("ok.bad.example", "allow", "add", day("2024-02-01")),
        ("bad.example/x", "block", "add", day("2024-01-01")), (None, "block", "add", day("2024-01-01")),
        ("bad.example", "block", "add", day("2024-03-01")), ("late.example", "block", "add", None),
    ]
    url = "https://user:pw@WWW.Bad.example.:8080/a/b?q#f"
    times = ["2024-01-09T23:59:59", "2024-01-10T00:00:00", "2024-02-29T23:59:59", "2024-03-01T00:00:00", "2024-12-01T00:00:00"]
    captures = [(1, url, day(t)) for t in times]
    captures += [(2, "http://ok.bad.example/", day(t)) for t in ("2024-01-20", "2024-02-02")]
    captures += [(3, "http://bad.example/x/y", day("2024-01-05")), (4, None, day("2024-02-01")), (5, "no url", day("2024-02-01"))]
    captures += [(6, "http://bad.example/", None), (7, "http://notbad.example/", day("2024-02-01")), (3, "http://bad.example/x/y", day("2024-01-05"))]
    got = judged(spark, captures, changes)
    block = (True, "bad.example")
    assert [got[1, day(t)] for t in times] == [(False, None), block, block, block, block]  # add and remove at one moment: add
    assert got[2, day("2024-01-20")] == block and got[2, day("2024-02-02")] == (False, "ok.bad.example")
    assert got[3, day("2024-01-05")] == (True, "bad.example/x")
    assert {got[4, day("2024-02-01")], got[5, day("2024-02-01")], got[6, None], got[7, day("2024-02-01")]} == {(False, None)}
    assert len(got) == 12


def test_empty_tables(spark):
    assert judged(spark, [], []) == {}
    assert judged(spark, [(1, "http://a.b/", day("2024-01-01"))], []) == {(1, day("2024-01-01")): (False, None)}
    assert judged(spark, [], [("a.b", "block", "add", day("2024-01-01"))]) == {}


def test_a_hot_host_is_split_by_month(spark):
    plan = uf.judge(
        spark.createDataFrame([(1, "http://a.b/", day("2024-01-01"))], CAPTURES),
        spark.createDataFrame([("a.b", "block", "add", day("2024-01-01"))], CHANGES),
    )._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
