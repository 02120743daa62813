"""Request streams: shared flights, expiry, results awaited together, replays from the checkpoint; as-of lookups."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from talentgrid.operators import asof as A
from talentgrid.operators import numbering as N
from talentgrid.streaming import requests as R

EVENTS = "key string, kind string, request_id string, value string, ts timestamp"
SETS = "set_id string, role_id long, kind string, value string, ts timestamp"


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


@pytest.fixture
def utc(spark):
    return spark


def write(spark, tmp_path, batches, kind):
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/in/f{n}")


def run(spark, tmp_path, kind, make, files=1):
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", files).parquet(f"{tmp_path}/in/*")
    q = make(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/log").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out")


BATCHES = [
    [("a", "request", "a1", None, at(0)), ("a", "request", "a2", None, at(1)), ("b", "request", "b1", None, at(2)), ("c", "result", None, "9", at(2))],
    [("a", "result", None, "va", at(3)), ("a", "request", "a3", None, at(4)), (None, "request", "x", None, at(4))],
    [("a", "result", None, "vb", at(5)), ("d", "request", "d1", None, at(40))],
    [("b", "request", "b2", None, at(60)), ("d", "result", None, "late", at(61))],
    [("e", "request", "e1", None, at(100))],
    [("e", "request", "e2", None, at(101))],
]


def test_each_key_is_computed_once_while_in_flight(spark, tmp_path):
    write(spark, tmp_path, BATCHES[:3], EVENTS)
    make = lambda s: R.single_flight(s, 10_000)
    run(spark, tmp_path, EVENTS, make)
    write(spark, tmp_path / "more", BATCHES[3:], EVENTS)
    for n in range(3):  # arrives after the query was stopped; it goes on from its checkpoint
        (tmp_path / "more" / "in" / f"f{n}").rename(tmp_path / "in" / f"f{n + 3}")
    rows = run(spark, tmp_path, EVENTS, make)
    got = sorted((r["key"], r["kind"], r["flight"], r["request_id"], r["value"]) for r in rows.collect())
    want = [
        ("a", "answer", "a1", None, "va"), ("a", "answer", "a3", None, "vb"), ("a", "attach", "a1", "a2", None), ("a", "compute", "a1", "a1", None), ("a", "compute", "a3", "a3", None),
        ("b", "compute", "b1", "b1", None), ("b", "compute", "b2", "b2", None), ("b", "expired", "b1", None, None), ("c", "stray", None, None, "9"),
        ("d", "compute", "d1", "d1", None), ("d", "expired", "d1", None, None), ("d", "stray", None, None, "late"), ("e", "attach", "e1", "e2", None), ("e", "compute", "e1", "e1", None),
    ]
    assert [r for r in got if r[:2] != ("b", "expired") or r[2] == "b1"] == want
    ends = {r["request_id"]: (r["computed"], r["outcome"], r["value"]) for r in R.answers(rows).collect()}
    assert ends["a1"] == (True, "answer", "va") and ends["a2"] == (False, "answer", "va") and ends["a3"] == (True, "answer", "vb")
    assert ends["b1"] == (True, "expired", None) and ends["d1"] == (True, "expired", None) and ends["e2"] == (False, "open", None)


def test_batches_do_not_matter(spark, tmp_path):
    flat = [[r for b in BATCHES for r in b]]
    for name, batches, files in (("one", flat, 1), ("all", BATCHES, 6)):
        write(spark, tmp_path / name, batches, EVENTS)
        run(spark, tmp_path / name, EVENTS, lambda s: R.single_flight(s, 10_000), files)
    one, all_ = (sorted((r["key"], r["kind"], r["flight"] or "", r["request_id"] or "") for r in spark.read.parquet(f"{tmp_path}/{n}/out").filter("key <> 'b' or flight <> 'b2'").collect()) for n in ("one", "all"))
    assert one == all_ and len(one) >= 12


def test_results_are_released_together_or_at_the_limit(spark, tmp_path):
    batches = [
        [("s", 1, "select", None, at(0)), ("s", 2, "select", None, at(0)), ("s", 3, "select", None, at(0)), ("s", 1, "gap", "g1", at(1)), ("t", 9, "path", "early", at(1))],
        [("s", 1, "path", "p1", at(2)), ("s", 2, "path", "p2", at(3)), ("s", 1, "path", "again", at(4)), ("t", 9, "select", None, at(5)), ("t", 9, "gap", "g9", at(6))],
        [("u", 1, "select", None, at(200)), (None, 1, "path", "x", at(200))],
        [("u", 1, "path", "p", at(201))],
    ]
    write(spark, tmp_path, batches, SETS)
    rows = run(spark, tmp_path, SETS, lambda s: R.settle_all(s, 90_000))
    got = {(r["set_id"], r["role_id"], r["late"]): (r["path"], r["gap"], r["missing"], r["ts"]) for r in rows.collect()}
    assert got[("s", 1, False)] == ("p1", "g1", [], at(2)) and got[("s", 1, True)] == ("again", None, [], at(4))
    assert got[("s", 2, False)] == ("p2", None, ["gap"], at(90)) and got[("s", 3, False)] == (None, None, ["path", "gap"], at(90))
    assert got[("t", 9, False)][:3] == ("early", "g9", []) and not any(k[0] == "u" for k in got)
    selected = spark.createDataFrame([r for b in batches for r in b], SETS).filter("kind = 'select'")
    assert {r["set_id"]: (r["prepared"], r["missing"]) for r in R.prepared_sets(selected, rows).collect()} == {"s": (True, 3), "t": (True, 0), "u": (False, 0)}


def test_asof_against_brute_force(spark):
    rng = random.Random(4)
    entries = [(rng.choice("abc"), rng.randint(0, 40), i) for i in range(60)] + [(None, 1, 99), ("a", None, 98)]
    rows = [(i, rng.choice([*"abcd", None]) if i % 3 else "a", rng.choice([None, *range(-3, 45)]) if i % 5 else 7) for i in range(500)] + [(7, "a", 7)] * 2
    want = []
    for i, k, t in rows:
        at_ = sorted({e[1]: max(x for x in entries if x[:2] == e[:2]) for e in entries if e[0] == k and e[1] is not None and k is not None}.items())
        before = [e for a, e in at_ if t is not None and a <= t]
        after = [e for a, e in at_ if before and a > before[-1][1]]
        want.append((i, k, t, before[-1][2] if before else None, after[0][2] if after else None))
    e = spark.createDataFrame(entries, "k string, at int, n int")
    r = spark.createDataFrame(rows, "id int, k string, t int")
    key = lambda x: tuple((v is not None, v) for v in x)
    for size in (1, 4096):
        x = A.asof(r, e, "k", "t", "at", run_rows=size).select("id", "k", "t", "entry.n", F.col("next_entry.n").alias("m"))
        assert sorted(map(tuple, x.collect()), key=key) == sorted(want, key=key)
    first = A.asof(r.filter("t < 0 and k = 'a'"), e, "k", "t", "at", before_first=True).select("entry.n").distinct().collect()
    assert [x[0] for x in first] == [max(n for k, a, n in entries if k == "a" and a == min(y[1] for y in entries if y[0] == "a" and y[1] is not None))]
    assert A.asof(r.limit(0), e, "k", "t", "at").count() == 0 and A.asof(r, e.limit(0), "k", "t", "at").filter("entry is null").count() == len(rows)


def test_numbers_have_no_gaps(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["x", "x", "x", "y", None]), rng.randint(0, 9)) for _ in range(700)]
    df = spark.createDataFrame(rows, "a string, b int")
    got = sorted((r["n"], r["a"], r["b"]) for r in N.numbered(df, ["a", F.desc("b")], "n", tasks=5).collect())
    assert [g[0] for g in got] == list(range(1, 701))
    assert [g[1:] for g in got] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", -r[1]))
    assert N.numbered(df.limit(0), ["a"], "n").count() == 0
    p = N.pages(df, ["a", "b"], 64, 3).groupBy("page").agg(F.count("*").alias("c"), F.max("place").alias("m")).orderBy("page").collect()
    assert [r["c"] for r in p] == [64] * 10 + [60] and [r["m"] for r in p] == [64] * 10 + [60]
    s = spark.range(25).select(F.col("id").cast("int").alias("id"), (F.col("id") % 3).cast("int").alias("g"))
    seen, last = [], None
    while page := N.page(s, ["g", "id"], 7, last).collect():
        seen += [(r["g"], r["id"]) for r in page]
        last = page[-1].asDict()
    assert seen == sorted((i % 3, i) for i in range(25))
