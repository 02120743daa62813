"""Tasks of a bounded size, and keys made from one pass over a text."""

from pyspark.sql import functions as F

from talentgrid import scratch
from talentgrid.functions import text as T
from talentgrid.sources import standins as X


def test_tasks_grow_with_the_rows(spark, sf, monkeypatch):
    monkeypatch.setattr(scratch, "TASK_ROWS", 500)
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert X.role_skills.__wrapped__(spark, sf).rdd.getNumPartitions() >= rows // 500 > 4


def test_keys_of_one_pass(spark):
    texts = ["", "  ", "C++ / c#", "a  b", " a\tb \n c ", "x + y", "+-+", "Straße   9", "a - b", "a -  - b", "　 z", "one two", "##", "é è"]
    x = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    t = F.col("t")
    own = F.trim(F.regexp_replace(T.folded(F.coalesce(t, F.lit(""))), "[^a-z0-9+#]+", " "))
    plain = F.trim(F.regexp_replace(t, T.SPACES, " "))
    k = T.bind(T.skill_key(t), T.keys_of)
    x = x.select(F.array(k["skill"], k["compact"], k["cert"], T.clean_text(t)).alias("got"), F.array(own, T.compact_key(t), T.certification_key(t), F.when(plain != "", plain)).alias("want"))
    assert all(r["got"] == r["want"] for r in x.collect())


def test_documents_send_no_table_to_the_driver(spark, sf):
    d = f"{sf}/../sf0.001"  # a folder of its own: the tables are derived anew
    made = [X.profile_items.__wrapped__(spark, d), X.profile_skills.__wrapped__(spark, d), X.profile_certs.__wrapped__(spark, d), X.experience.__wrapped__(spark, d), X.cvs(spark, d)]
    for x in made:
        plan = x._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan or "SortMergeJoin" in plan
        assert "Broadcast" not in plan
    scans = [p for x in made[1:] for p in x.inputFiles() if "lineitem" in p]
    assert not scans  # the line items are read once, for profile_items


def test_evidence_is_read_from_one_table(spark, tmp_path):
    from talentgrid.operators import prepared as P
    from talentgrid.operators import profiles as D

    docs = spark.createDataFrame([(50, ["red  gear", "Blue gear"], ["built the old bolt"]), (100, [], [])], "profile_id long, explicit array<string>, context array<string>")
    docs.write.json(f"{tmp_path}/docs")
    docs = spark.read.schema(docs.schema).json(f"{tmp_path}/docs")
    names = spark.createDataFrame([("red gear", "red gear")], "key string, name string")
    edges = spark.createDataFrame([("red gear", "new gear"), ("new gear", "old gear")], "src string, dst string")
    aliases = spark.createDataFrame([], "key string, canonical string")
    plain, D.evidence = D.evidence, lambda x, key="profile_id": x
    try:
        got = D.prepared_of(docs, lambda e, c: P.prepare(e, c, aliases, names, edges))
    finally:
        D.evidence = plain
    assert not [f for f in got.inputFiles() if f.endswith(".json")]  # the documents are parsed once
    assert {(r["key"], r["source"]) for r in got.collect()} == {("red gear", "explicit"), ("blue gear", "explicit"), ("built the old bolt", "context"), ("new gear", "ontology_implied"), ("old gear", "ontology_implied")}


def test_held_skills_are_not_sent_round(spark):
    from talentgrid.operators import ontology as O

    held = spark.createDataFrame([(50 * i, "a") for i in range(10)], "profile_id long, skill string")
    edges = spark.range(2000).select(F.concat(F.lit("s"), F.col("id")).alias("src"), F.concat(F.lit("s"), F.col("id") + 1).alias("dst")).unionByName(spark.createDataFrame([("a", "s5")], "src string, dst string"))
    x = O.implied_with_hops(held, edges)
    rows = {(r["profile_id"], r["skill"], r["hop"]) for r in x.collect()}
    assert rows == {(50 * i, f"s{4 + h}", h) for i in range(10) for h in (1, 2, 3)}
    joins = [p for p in x._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in p and "via" in p]
    assert len(joins) == 1 and "rightHint=(strategy=broadcast)" in joins[0]  # the vocabulary, whatever the number of profiles


def test_role_skills_are_grouped_by_hash(spark, sf):
    x = X.role_skills.__wrapped__(spark, sf)
    assert "SortAggregate" not in x._jdf.queryExecution().executedPlan().toString()
    p, li = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("part", "lineitem"))
    least = li.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("role_id"), F.col("p_name").alias("skill")).agg(F.min("p_type").alias("least"))
    assert x.count() == x.join(least, ["role_id", "skill"]).filter(F.col("domain") == F.col("least")).count() > 0


def test_reply_reads_its_items_once(spark):
    from talentgrid.operators.catalog import parsed_reply

    reply = '{"processed_job_title":" T ","skill_domains":[{"domain":"d","skills":[{"skill":"x ","score":2},{"skill":"y","score":0.5}]},{"domain":"e","skills":[{"skill":"x","score":0.25}]}]}'
    x = spark.createDataFrame([(reply,), ('{"skill_domains":[]}',), ('{"skill_domains":[null]}',), ("no",), (None,)], "r string").select(parsed_reply(F.col("r")).alias("p"))
    assert [r["p"] and (r["p"]["title"], [tuple(i) for i in r["p"]["items"]]) for r in x.collect()] == [("T", [("x", "e", 0.25), ("y", "d", 0.5)]), None, None, None, None]
    trims = x._jdf.queryExecution().optimizedPlan().toString().count("trim(")
    assert trims < 12  # of skills and domains: not once for every use of the items
