"""Coverage of gaps by key, raw coverage with and without an ontology, theses, and edits that clash."""

import json

from pyspark.sql import functions as F

from talentgrid.operators import coverage as V
from talentgrid.operators import edits as E
from talentgrid.operators import gaps as G
from talentgrid.operators import profiles as D
from talentgrid.sources import standins as X


def test_coverage_of_a_gap_by_its_key(spark):
    rows = [("p", 1, s, s, t, t, 0.5, 1.0, i, 0.0, "high", "important", 1, "", None) for i, (s, t) in enumerate([("a", "Data Engineering"), ("b", "data-engineering"), ("c", "Cloud"), ("d", "none")])]
    kind = "profile_id string, role_id int, required string, display string, domain string, tag string, weight double, x double, ord int, score double, severity string, importance string, importance_rank int, source string, closest string"
    domains = spark.createDataFrame([("p", 1, "data engineering", 0.4, 2), ("p", 1, "DATA ENGINEERING", 0.9, 5), ("p", 1, "Cloud", 1.0, 3), ("p", 1, "cloud", 0.0, 1)], "profile_id string, role_id int, domain string, coverage double, ord int")
    got = {r["display"]: r["priority"] for r in G.ranked_gaps(spark.createDataFrame(rows, kind), domains).collect()}
    plain = {r["display"]: r["priority"] for r in G.ranked_gaps(spark.createDataFrame(rows, kind), domains.limit(0)).collect()}
    # the first name of the key for a and b; the very name for c though another comes first
    assert {k: round(plain[k] - got[k], 6) for k in got} == {"a": 0.04, "b": 0.04, "c": 0.1, "d": 0.0}


def coverage(spark, raw, held, names, reach):
    required = spark.createDataFrame([(1, raw)], "role_id int, raw_skills string")
    x = V.raw_coverage(required, spark.createDataFrame([("p", h) for h in held], "profile_id string, term string"), names, reach).first()
    return round(x["coverage"], 6), x["matched"], [tuple(g) for g in x["gaps"]]


def test_raw_coverage(spark):
    assert coverage(spark, "Python, SQL, FastAPI", ["python", " sql "], None, None) == (0.666667, ["Python", "SQL"], [("FastAPI", None, 0.0, "high")])
    names = spark.createDataFrame([("react", "React"), ("react js", "React"), ("javascript", "JavaScript"), ("js", "JavaScript")], "key string, name string")
    reach = spark.createDataFrame([("React", "React"), ("React", "JavaScript"), ("JavaScript", "JavaScript")], "src string, dst string")
    assert coverage(spark, "JS; React.js;react", ["React"], names, reach) == (1.0, ["JavaScript", "React"], [])
    assert coverage(spark, "React, Juggling", ["js", "Juggling"], names, reach) == (0.2, [], [("React", "JavaScript", 0.4, "medium"), ("Juggling", None, 0.0, "high")])
    assert coverage(spark, None, ["js"], names, reach) == (0.0, [], []) and coverage(spark, " ; ", ["js"], None, None) == (0.0, [], [])


def test_documents_without_theses_stay_as_they_were(spark, sf):
    full, cvs = X.full_cvs(spark, sf), X.cvs(spark, sf)
    plain = full.drop("thesis").withColumn("education", F.transform("education", lambda e: e.dropFields("thesis_title")))
    assert D.evidence(plain).orderBy("profile_id").collect() == D.evidence(cvs).orderBy("profile_id").collect()
    names = {r["field"] for r in D.comparable_fields(full).select("field").distinct().collect()} - {r["field"] for r in D.comparable_fields(cvs).select("field").distinct().collect()}
    assert names == {"thesis_titles", "thesis_technologies", "location", "links"}


DOC = "profile_id int, personal_info struct<current_role:string,age:int>, interests array<string>, projects array<struct<title:string,technologies:array<string>>>"


def test_edits_in_order_and_clashing(spark):
    docs = spark.createDataFrame([(1, ("dev", 3), ["a", "b"], [("p", ["x"]), ("q", [])]), (2, None, None, [])], DOC)
    log = [
        (1, 5, "delete", "projects.0", None), (1, 2, "set", "projects.0.title", "first"), (1, 9, "set", "projects.0.title", "second is first now"), (1, 3, "set", "projects.1.technologies", '["y", "z"]'),
        (1, 4, "set", "projects.1.technologies", '["y", 1]'), (1, 6, "delete", "interests.7", None), (1, 7, "delete", "interests.-1", None), (1, 8, "append", "interests", ""), (1, 10, "set", "personal_info.age", "4.5"),
        (1, 11, "set", "personal_info.current_role", " "), (1, 12, "set", "personal_info.shoe", "42"), (1, 13, "fly", "interests", None), (1, 14, "replace", "interests", '["only"]'), (1, 15, None, None, None), (1, None, "set", "interests", "x"),
        (2, 1, "append", "interests", "x"), (2, 2, "set", "personal_info.age", "1"), (2, 3, "set", "personal_info", '{"current_role": "r"}'), (2, 4, "confirm", "interests", None), (2, 5, "skip", "interests", None), (3, 1, "set", "interests", "x"),
    ]
    edits = spark.createDataFrame(log, "profile_id int, seq int, op string, path string, value string")
    got = {r["profile_id"]: r for r in E.apply_edits(docs, edits).collect()}
    one, two = got[1], got[2]
    assert one["doc"].asDict(True) == {"personal_info": {"current_role": None, "age": 3}, "interests": ["only"], "projects": [{"title": "second is first now", "technologies": ["y", "z"]}]}
    assert [r["seq"] for r in one["rejected"]] == [4, 6, 7, 10, 12, 13, 15] and one["edited"] == ["projects.0.title", "projects.1.technologies", "projects", "interests", "projects.0.title", "personal_info.current_role", "interests"]
    assert two["doc"].asDict(True) == {"personal_info": {"current_role": "r", "age": None}, "interests": None, "projects": []}
    assert [r["seq"] for r in two["rejected"]] == [1, 2, 5] and (two["confirmed"], two["skipped"]) == (["interests"], []) and 3 not in got
    yes = E.apply_edits(docs, edits, assume_yes=True).filter("profile_id = 1").first()
    assert yes["confirmed"] == ["personal_info", "projects", "interests"] and json.loads(spark.createDataFrame([yes["doc"]]).toJSON().first())["interests"] == ["a", "b"]
    assert E.apply_edits(docs.limit(0), edits).count() == 0 and E.apply_edits(docs, edits.limit(0)).filter("size(edited) = 0 and doc is not null").count() == 2
