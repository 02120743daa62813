"""The catalogue job: full build, build of changes, retry of failures, and what each of them reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import builds as B
from ..operators import catalog as K
from ..scratch import cut, scratch_dir
from ..sources import standins as X
from ..sources.tables import table
from .profile_queries import _tidy


def catalog_inputs(spark: SparkSession, d: str) -> DataFrame:
    """What every role is built from; the reply of a model is made of the role's weighted skills."""
    s = X.role_skills(spark, d)
    item = F.struct("ord", "skill", F.struct("skill", F.lit("x").alias("tier"), (F.col("weight") * 1.2).alias("score")).alias("i"))
    groups = s.groupBy("role_id").agg(F.array_sort(F.collect_list(item)).alias("x"))
    body = F.to_json(F.struct(F.lit("Clean Title").alias("processed_job_title"), F.array(F.struct(F.lit("Core").alias("domain"), F.transform("x", lambda x: x["i"]).alias("skills"))).alias("skill_domains")))
    groups = groups.select("role_id", F.array_join(F.transform("x", lambda x: x["skill"]), ", ").alias("skills"), body.alias("reply"))
    certs = X.role_certs(spark, d).groupBy("role_id").agg(F.array_join(F.array_sort(F.collect_set("cert")), ", ").alias("certifications"))
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    x = X.roles(spark, d).join(groups, "role_id").join(certs, "role_id", "left").join(e, F.col("role_id") == F.col("vec_id"), "left")
    k = F.col("role_id")
    return x.select(
        "role_id",
        "title",
        "description",
        "domain_tags",
        "skills",
        "certifications",
        F.lit(None).cast("string").alias("raw_certifications"),
        F.when(k % 4 == 3, " ; ").otherwise("a, b").alias("raw_skills"),
        "reply",
        F.lit(None).cast("array<float>").alias("vector"),
        F.when(k % 9 == 0, F.slice("embedding", 1, 10)).otherwise(F.col("embedding")).alias("capability_vector"),
        F.when(k % 6 != 0, F.when(k % 7 == 0, F.transform("embedding", lambda v: v * F.lit(2).cast("float"))).otherwise(F.col("embedding"))).alias("intent_vector"),
    )


def _unusable(reply: Column, when: Column) -> Column:
    return F.when(when, F.replace(reply, F.lit('"score"'), F.lit('"points"'))).otherwise(reply)


def _first(inputs: DataFrame) -> DataFrame:
    k = F.col("role_id")
    return inputs.filter(k % 10 != 7).withColumn("reply", _unusable(F.col("reply"), k % 4 == 2))


def _second(inputs: DataFrame, mended: bool = False) -> DataFrame:
    k = F.col("role_id")
    text = F.when(k % 5 == 0, F.concat("description", F.lit(" Updated."))).otherwise(F.col("description"))
    return inputs.filter(k % 10 != 3).withColumns({"description": text, "reply": _unusable(F.col("reply"), F.lit(not mended) & (k % 8 == 2))})


def _catalogue(spark: SparkSession) -> B.Catalogue:
    return B.Catalogue(spark, f"{scratch_dir(spark)}/talentgrid/catalogue-{uuid.uuid4().hex}")


def _no_vectors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "skill string, vector array<float>")


def catalog_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """Every role after a first build, a build of what changed since, and a retry of what failed."""
    inputs, none, c = cut(catalog_inputs(spark, d), "inputs"), _no_vectors(spark), _catalogue(spark)
    c.build(_first(inputs), none)
    c.build(_second(inputs), none)
    c.retry(_second(inputs, mended=True), none)
    c.vacuum()
    x = c.state()
    ranked = F.transform(B.listed_skills(F.col("sort_skills")), lambda s: F.concat_ws(":", s["skill"], s["domain"], F.format_string("%.4f", s["score"])))
    return x.select("role_id", "build", "failed", F.coalesce("processed_job_title", F.lit("")).alias("title"), "capability_text", F.array_join(ranked, "|").alias("ranked"))


HEAD = f"""WITH {X.SQL['role_skills']}, {X.SQL['roles']}, {X.SQL['profiles']}, {X.SQL['certs']},
s AS (SELECT role_id, string_agg(skill, ', ' ORDER BY ord) AS skills,
        string_agg(skill || ':Core:' || printf('%.4f', score), '|' ORDER BY score DESC, ord) AS ranked
      FROM (SELECT *, round(0.85::DOUBLE * least(1.0::DOUBLE, weight * 1.2::DOUBLE), 4) AS score FROM role_skills) GROUP BY 1),
c AS (SELECT role_id, string_agg(DISTINCT cert, ', ' ORDER BY cert) AS certs FROM role_certs GROUP BY 1)"""

CATALOG_REBUILD = f"""{HEAD}
SELECT role_id, CASE WHEN role_id % 8 = 2 THEN 3 WHEN role_id % 10 = 7 OR role_id % 5 = 0 OR role_id % 8 = 6 THEN 2 ELSE 1 END AS build, false AS failed,
  CASE WHEN role_id % 4 = 3 THEN '' ELSE 'Clean Title' END AS title,
  concat_ws(chr(10), 'Job title: ' || title, 'Required skills: ' || skills, 'Certifications: ' || certs,
    'Responsibilities: ' || {_tidy("description || CASE WHEN role_id % 5 = 0 THEN ' Updated.' ELSE '' END")}) AS capability_text,
  CASE WHEN role_id % 4 = 3 THEN '' ELSE ranked END AS ranked
FROM roles JOIN s USING (role_id) LEFT JOIN c USING (role_id) WHERE role_id % 10 <> 3"""


def catalog_changes(spark: SparkSession, d: str) -> DataFrame:
    """What a build of the second state would do with each role of the first: a dry run's list."""
    inputs, c = cut(catalog_inputs(spark, d), "inputs"), _catalogue(spark)
    c.build(_first(inputs), _no_vectors(spark))
    return c.changes(_second(inputs)).select("role_id", "status")


CATALOG_CHANGES = f"""WITH {X.SQL['role_skills']}
SELECT DISTINCT role_id, CASE WHEN role_id % 10 = 3 THEN 'gone' WHEN role_id % 10 = 7 THEN 'new' WHEN role_id % 5 = 0 OR role_id % 8 = 6 THEN 'changed' ELSE 'same' END AS status FROM role_skills"""


def catalog_build_report(spark: SparkSession, d: str) -> DataFrame:
    """Counts of a first build: roles by what was done, and vectors by what is wrong with them, taken while writing."""
    report = _catalogue(spark).build(_first(catalog_inputs(spark, d)), _no_vectors(spark))
    left_out = ("buckets", "waves", "build")
    return spark.createDataFrame([(k, int(v)) for k, v in report.items() if k not in left_out], "what string, n long")


CATALOG_BUILD_REPORT = f"""WITH {X.SQL['role_skills']},
r AS (SELECT role_id, embedding FROM (SELECT DISTINCT role_id FROM role_skills) LEFT JOIN embeddings ON vec_id = role_id WHERE role_id % 10 <> 7),
m AS (SELECT count(*) AS n, count(*) FILTER (embedding IS NULL) AS cm, count(*) FILTER (embedding IS NOT NULL AND role_id % 9 = 0) AS cw,
        count(*) FILTER (embedding IS NULL OR role_id % 6 = 0) AS im, count(*) FILTER (embedding IS NOT NULL AND role_id % 6 <> 0 AND role_id % 7 = 0) AS iu FROM r)
SELECT unnest(['new', 'changed', 'same', 'gone', 'skipped', 'rows', 'capability_vector_missing', 'capability_vector_wrong_size', 'capability_vector_not_unit',
  'intent_vector_missing', 'intent_vector_wrong_size', 'intent_vector_not_unit']) AS what, unnest([n, 0, 0, 0, 0, n, cm, cw, 0, im, 0, iu]) AS n FROM m"""


def sort_skills_json(spark: SparkSession, d: str) -> DataFrame:
    """Weight, domain and display of every role's skills, read from the JSON column of a built catalogue."""
    c = _catalogue(spark)
    c.build(catalog_inputs(spark, d), _no_vectors(spark))
    return K.skill_maps(B.skill_rows(c.state())).select("role_id", "key", "weight", "domain", "display", "ord")


SORT_SKILLS_JSON = f"""WITH {X.SQL['role_skills']}, x AS (SELECT *, round(0.85::DOUBLE * least(1.0::DOUBLE, weight * 1.2::DOUBLE), 4) AS score FROM role_skills WHERE role_id % 4 <> 3)
SELECT role_id, lower(skill) AS key, score AS weight, 'Core' AS domain, skill AS display, (row_number() OVER (PARTITION BY role_id ORDER BY score DESC, ord))::INT AS ord FROM x"""

QUERIES = {
    "catalog_rebuild": (catalog_rebuild, CATALOG_REBUILD),
    "catalog_changes": (catalog_changes, CATALOG_CHANGES),
    "catalog_build_report": (catalog_build_report, CATALOG_BUILD_REPORT),
    "sort_skills_json": (sort_skills_json, SORT_SKILLS_JSON),
}
