"""Operators on small hand-made frames."""

import json

import pytest
from pyspark.sql import functions as F

from talentgrid.operators import alignment as A
from talentgrid.operators import catalog as K
from talentgrid.operators import metrics as M
from talentgrid.operators import ontology as O
from talentgrid.operators import prepared as P
from talentgrid.operators import recommend as R
from talentgrid.operators import tables as X
from talentgrid.sources import tables as S
from talentgrid.sources.ontology import judgements, ontology


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_implied_within_hops_on_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "a")], "src string, dst string")
    held = spark.createDataFrame([(1, "a", 1)], "profile_id int, skill string, ord int")
    assert rows(O.implied_with_hops(held, edges)) == [(1, "b", 1, "a", 0.65), (1, "c", 2, "a", 0.52), (1, "d", 3, "a", 0.416)]


def test_closure_of_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")
    assert rows(O.closure(edges)) == [("a", "a"), ("a", "b"), ("a", "c"), ("b", "a"), ("b", "b"), ("b", "c"), ("c", "c")]


def test_mmr_prefers_the_distinct(spark):
    scored = spark.createDataFrame([(1, "next_step", 1, 0.90), (1, "next_step", 2, 0.88), (1, "next_step", 3, 0.70)], "profile_id int, bucket string, role_id int, final_score double")
    features = spark.createDataFrame([(1, ["x", "y"], ["a"]), (2, ["x", "y"], ["b"]), (3, ["z"], ["c"])], "role_id int, feature array<string>, words array<string>")
    assert {r["pos"]: r["role_id"] for r in R.mmr(scored, features, 2).collect() if r["pos"]} == {1: 1, 2: 3}


def test_like_titles_are_redundant(spark):
    names = spark.createDataFrame([(1, "Senior Data Analyst"), (2, "Data Analyst"), (3, "Nurse")], "role_id int, title string")
    features = names.select("role_id", F.array(F.col("role_id").cast("string")).alias("feature"), R.title_tokens(F.col("title")).alias("words"))
    scored = spark.createDataFrame([(1, "next_step", 1, 0.90), (1, "next_step", 2, 0.89), (1, "next_step", 3, 0.65)], "profile_id int, bucket string, role_id int, final_score double")
    assert {r["pos"]: r["role_id"] for r in R.mmr(scored, features, 2).collect() if r["pos"]} == {1: 1, 2: 3}


def test_final_score_ranks_whatever_the_bucket(spark):
    one = "profile_id int, role_id int, capability double, intent double, identity double, skill double, domain double, seniority double"
    x = R.score_candidates(spark.createDataFrame([(1, 1, 1.0, 0.0, 1.0, 0.2, 1.0, 0.0)], one)).first()
    assert x["bucket"] == "ready_now" and x["bucket_score"] == round(0.30 + 0.40 + 0.23 * 0.2 + 0.09 * 0.5, 9)
    assert x["final_score"] == round(0.20 + 0.30 + 0.23 * 0.2 + 0.10 * 0.5, 9)


def test_set_scores(spark):
    e = spark.createDataFrame([(1, ["python", "sql", "power bi"]), (2, []), (3, ["python"])], "k int, values array<string>")
    a = spark.createDataFrame([(1, ["python", "sql", "excel"]), (2, []), (3, [])], "k int, values array<string>")
    got = {r["k"]: round(r["f1"], 6) for r in M.set_scores(e, a, ["k"]).collect()}
    assert got == {1: 0.666667, 2: 1.0, 3: 0.0}


def test_duplicate_titles_count_once(spark):
    ranked = spark.createDataFrame([("q", "a", 1, 3, "x", "x"), ("q", "A.", 2, 3, "x", "y")], "query string, title string, pos int, relevance int, bucket string, expected_bucket string")
    ideal = spark.createDataFrame([("q", 3)], "query string, relevance int")
    r = M.ranking_metrics(ranked, ideal).first()
    assert (r["duplicates"], round(r["ndcg"], 6), round(r["p3"], 6), r["mrr"], r["bucket_accuracy"]) == (1, 1.0, 0.333333, 1.0, 1.0)


def test_judgement_by_role_then_by_first_title(spark):
    ranked = spark.createDataFrame([("q", 1, "Data  Analyst"), ("q", 2, "data-analyst"), ("q", 3, "cook")], "query string, role_id int, title string")
    j = spark.createDataFrame([("q", 1, "x", 3, "a", 1), ("q", 9, "Data Analyst", 2, "b", 2), ("q", 8, "data analyst", 1, "c", 3)], "query string, role_id int, title string, relevance int, expected_bucket string, ord int")
    assert rows(M.judged(ranked, j).select("role_id", "relevance", "expected_bucket").fillna({"relevance": -1, "expected_bucket": ""})) == [(1, 3, "a"), (2, 2, "b"), (3, -1, "")]


def test_greedy_text_matches_are_one_to_one(spark):
    x = spark.createDataFrame([(["M.Sc. of Data", "java", "c"], ["master of science in data", "javascript", "JAVA!", "cc"])], "e array<string>, a array<string>")
    r = M.list_scores(x, "e", "a").first()
    assert (r["matched"], r["missing"], r["extra"]) == (2, "c", "cc,javascript")
    assert r["precision"] == 2 / 4 and r["recall"] == 2 / 3


def test_prepared_profile_tiers(spark):
    explicit = spark.createDataFrame([(1, "Next.js", 1), (1, " next js ", 2), (1, "K8s", 3)], "profile_id int, term string, ord int")
    context = spark.createDataFrame([(1, "kubernetes", 1), (1, "led a team", 2)], "profile_id int, term string, ord int")
    aliases = P.clean_aliases(spark.createDataFrame([("K8S", "Docker", 1), ("k8s", "Kubernetes", 2), ("", "x", 3)], "alias string, canonical string, ord int"))
    names = spark.createDataFrame([("next js", "Next.js"), ("react", "React"), ("javascript", "JavaScript")], "key string, name string")
    edges = spark.createDataFrame([("Next.js", "React"), ("React", "JavaScript"), ("JavaScript", "Next.js")], "src string, dst string")
    got = {r["key"]: (r["display"], r["source"], r["confidence"]) for r in P.prepare(explicit, context, aliases, names, edges).collect()}
    assert got == {
        "next js": ("Next.js", "explicit", 1.0),
        "kubernetes": ("K8s", "explicit", 1.0),
        "led a team": ("led a team", "context", 1.0),
        "react": ("React", "ontology_implied", 0.65),
        "javascript": ("JavaScript", "ontology_implied", 0.52),
    }


def test_short_requirements_are_mentioned_anywhere(spark):
    req = spark.createDataFrame([("r",), ("go",), ("sql",), ("power bi",)], "required string")
    terms = spark.createDataFrame([("my google sheets",), ("powerbi report",), ("",)], "term string")
    got = rows(A.mentions(req, terms))
    assert got == [("go", "my google sheets"), ("power bi", "powerbi report"), ("r", "powerbi report")]


def test_own_name_beats_an_alias(spark):
    listed = spark.createDataFrame([(1, "Figma", "Tools", 0.2, 1), (1, "UI/UX Design", "Design", 0.9, 2), (1, "SQL", "", None, 3), (2, "SQL", "", None, 1)], "role_id int, skill string, domain string, score double, ord int")
    aliases = spark.createDataFrame([("figma", "ui ux design")], "key string, canonical string")
    hints = spark.createDataFrame([("sql", "Databases")], "key string, hint string")
    got = rows(A.requirements(listed, aliases, hints).select("role_id", "required", "display", "domain", "weight", "ord"))
    assert got == [(1, "sql", "SQL", "Databases", 0.5, 3), (1, "ui ux design", "UI/UX Design", "Design", 0.9, 1), (2, "sql", "SQL", "Databases", 1.0, 1)]


def test_reply_with_one_bad_part_is_unusable(spark):
    good = '```json {"processed_job_title": " X ", "skill_domains": [{"domain": "d", "skills": [{"skill": "a", "score": 2}, {"skill": "a", "score": 0.5}]}]}```'
    bad = '{"skill_domains": [{"domain": "d", "skills": [{"skill": "a", "score": 1}, {"skill": "", "score": 1}]}]}'
    x = spark.createDataFrame([(good,), (bad,), ("no json",), (None,)], "r string").select(K.parsed_reply(F.col("r")).alias("p")).collect()
    assert [r["p"] and (r["p"]["title"], [tuple(i) for i in r["p"]["items"]]) for r in x] == [("X", [("a", "d", 0.5)]), None, None, None]


def test_a_failed_ranking_keeps_the_old_one(spark):
    kind = "role_id int, sort_skills array<string>"
    ranked = spark.createDataFrame([(1, ["new"], False), (2, [], True)], kind + ", failed boolean")
    assert rows(K.kept_rankings(spark.createDataFrame([(1, ["a"]), (2, ["b"]), (3, ["c"])], kind), ranked)) == [(1, ["new"]), (2, ["b"]), (3, ["c"])]
    assert rows(K.failures(ranked)) == [("2",)] and K.failures(ranked.filter("role_id = 1")).count() == 0


def test_sinks_and_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert rows(S.json_table(spark, K.write_json(df, f"{tmp_path}/j"), "k int, v string", multiline=False)) == [(1, "a"), (2, "b")]
    assert rows(S.id_list(spark, K.write_text(spark.createDataFrame([("3, 1,3",)], "v string"), f"{tmp_path}/t"))) == [(1,), (3,)]


def test_vector_sizes_are_checked(spark):
    df = spark.createDataFrame([([1.0, 2.0],), (None,)], "v array<double>")
    assert K.checked_vectors(df, "v", 2).count() == 2
    with pytest.raises(Exception, match="size is not 3"):
        K.checked_vectors(df, "v", 3).collect()
    with pytest.raises(ValueError, match="no column w"):
        K.checked_vectors(df, "w", 3)


def test_upsert_and_update(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, None)], "k int, v string")
    assert sorted(map(repr, rows_or(X.upsert(old, new, ["k"])))) == ["(1, 'a')", "(2, 'c')", "(3, None)"]
    assert rows(X.update_from(old, spark.createDataFrame([(1, None), (2, "z")], "k int, v string"), ["k"])) == [(1, "a"), (2, "z")]


def rows_or(df):
    return [tuple(r) for r in df.collect()]


def test_ontology_file(spark, tmp_path):
    nodes = [
        {"name": "Next.js", "synonyms": ["NextJS"], "impliesKnowingSkills": ["react", "Unknown"], "technicalDomains": ["Web", "Web"], "associatedToApplicationDomains": ["Shop"]},
        {"name": "React", "synonyms": ["react.js"], "impliesKnowingSkills": None},
        {"name": "", "synonyms": ["x"]},
        {"name": "Preact", "synonyms": ["React"], "impliesKnowingSkills": []},
    ]
    for n, body in enumerate((nodes, {str(i): x for i, x in enumerate(nodes)})):
        path = tmp_path / f"o{n}.json"
        path.write_text(json.dumps(body, indent=1))
        o = ontology(spark, str(path))
        assert rows(o["names"].select("key", "name")) == [("next js", "Next.js"), ("nextjs", "Next.js"), ("preact", "Preact"), ("react", "Preact"), ("react js", "React")]
        assert rows(o["edges"]) == [("Next.js", "Preact"), ("Next.js", "Unknown")]
        assert {r["name"]: r["domains"] for r in o["nodes"].collect()} == {"Next.js": ["Web", "Shop"], "React": [], "Preact": []}


def test_fixture_file(spark, tmp_path):
    path = tmp_path / "f.json"
    path.write_text(json.dumps({"profiles": [{"name": "p", "judged_roles": [{"role_id": "7", "title": "T", "relevance": 2}, {"role_id": None, "title": "U", "relevance": 1, "expected_bucket": "next_step"}]}]}))
    assert [tuple(r) for r in judgements(spark, str(path)).orderBy("ord").collect()] == [("p", "7", "T", 2, None, 0), ("p", None, "U", 1, "next_step", 1)]
