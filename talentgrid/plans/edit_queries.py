"""Confirmed edits of profile documents: logs of single changes, and lists edited as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import edits as E
from ..sources import standins as X
from .profile_queries import HEAD


def edit_log(spark: SparkSession, d: str) -> DataFrame:
    """profile_id, seq, op, path, value: a dozen edits of every document, not in order, some impossible; every seventh quits."""
    x = X.profiles(spark, d)
    row = lambda seq, op, path, value=None: F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(op).alias("op"), F.lit(path).alias("path"), (value if value is not None else F.lit(None).cast("string")).alias("value"))
    log = [
        row(9, "append", "interests", F.concat(F.lit('"new '), "segment", F.lit('"'))),
        row(1, "set", "personal_info.current_role", F.concat(F.lit("Edited "), F.col("i").cast("string"))),
        row(4, "set", "projects.0.title", F.lit("x")),
        row(3, "delete", "projects.0"),
        row(2, "append", "interests", F.lit("first")),
        row(5, "set", "profile_summary.years_of_experience", F.lit("many")),
        row(6, "append", "personal_info", F.lit("x")),
        row(8, "set", "profile_summary.years_of_experience", F.lit("7")),
        row(7, "set", "experience.0.role", F.lit("Boss")),
        row(12, "confirm", "personal_info"),
        row(10, "confirm", "personal_info"),
        row(11, "skip", "projects"),
    ]
    return x.select("profile_id", "i", F.inline(F.array(*log))).unionByName(x.filter("i % 7 = 6").select("profile_id", "i", F.inline(F.array(row(13, "quit", ""))))).drop("i")


def apply_edits(spark: SparkSession, d: str) -> DataFrame:
    """Every document after its log, and what became of each edit."""
    x = E.apply_edits(X.cvs(spark, d), edit_log(spark, d))
    return x.select(
        "profile_id",
        "cancelled",
        F.col("doc.personal_info.current_role").alias("role"),
        F.array_join("doc.interests", ",").alias("interests"),
        F.size("doc.projects").alias("n_projects"),
        F.get(F.col("doc.experience"), F.lit(0))["role"].alias("first_role"),
        F.col("doc.profile_summary.years_of_experience").alias("years"),
        F.array_join("confirmed", ",").alias("confirmed"),
        F.array_join("skipped", ",").alias("skipped"),
        F.array_join("edited", ",").alias("edited"),
        F.array_join(F.transform("rejected", lambda r: F.concat_ws(":", r["seq"].cast("string"), r["reason"])), "|").alias("rejected"),
    )


APPLY_EDITS = f"""{HEAD}, n AS (SELECT profile_id, count(*) AS jobs FROM experience GROUP BY 1)
SELECT h.profile_id, h.i % 7 = 6 AS cancelled, CASE WHEN h.i % 7 <> 6 THEN 'Edited ' || h.i END AS role,
  CASE WHEN h.i % 7 <> 6 THEN array_to_string(list_concat(interests, ['first', 'new ' || segment]), ',') END AS interests, CASE WHEN h.i % 7 <> 6 THEN 0 ELSE NULL END AS n_projects,
  CASE WHEN h.i % 7 <> 6 AND jobs > 0 THEN 'Boss' END AS first_role, CASE WHEN h.i % 7 <> 6 THEN 7 END AS years, 'personal_info' AS confirmed, 'projects' AS skipped,
  'personal_info.current_role,interests,projects,' || CASE WHEN jobs > 0 THEN 'experience.0.role,' ELSE '' END || 'profile_summary.years_of_experience,interests' AS edited,
  '4:no item 0|5:value does not fit int|6:not a list|' || CASE WHEN jobs > 0 THEN '' ELSE '7:no item 0|' END || '12:no open section personal_info' AS rejected
FROM heads h JOIN profiles USING (profile_id) LEFT JOIN n USING (profile_id)"""


def recap_view(spark: SparkSession, d: str) -> DataFrame:
    """Every document as it is shown for editing."""
    x = E.recap(X.cvs(spark, d))
    lines = lambda c, *names: F.array_join(F.transform(c, lambda e: F.concat_ws("/", *[e[n].cast("string") for n in names])), "|").alias(c)
    return x.select("profile_id", lines("skills", "name", "confidence"), F.array_join("interests", ",").alias("interests"), lines("experiences", "role", "company", "summary", "start", "end"), lines("educations", "degree", "field", "school", "start", "end"), lines("certifications", "name", "issuer", "year"), lines("projects", "name", "detail", "start", "end"))


SHOWN = "CASE WHEN h.i % 3 = 0 THEN [] ELSE [segment, 'cloud', 'ui design', 'hiking'] END"
PARTS = f"""{HEAD}, jobs AS (SELECT *, array_to_string(resp, '; ') AS summary FROM experience),
sk AS (SELECT profile_id, string_agg(skill || '/90', '|' ORDER BY ord) AS skills, string_agg(skill || ':expert', '|' ORDER BY ord) FILTER (ord > 1) AS rest FROM profile_skills WHERE ord <= 6 GROUP BY 1)"""
RECAP_VIEW = f"""{PARTS},
ex AS (SELECT profile_id, string_agg(role || '/' || organization || '/' || summary || '/' || start_date || '/Present', '|' ORDER BY ord) AS experiences FROM jobs GROUP BY 1),
ce AS (SELECT profile_id, string_agg(cert || '/Board/2019', '|' ORDER BY ord) AS certifications FROM profile_certs GROUP BY 1)
SELECT h.profile_id, coalesce(skills, '') AS skills, array_to_string({SHOWN}, ',') AS interests, coalesce(experiences, '') AS experiences,
  degree_type || '/' || field_of_study || '/' || institution || '/2012/Present' AS educations, coalesce(certifications, '') AS certifications, 'Project ' || h.i || '//2020/—' AS projects
FROM heads h JOIN profiles USING (profile_id) LEFT JOIN sk USING (profile_id) LEFT JOIN ex USING (profile_id) LEFT JOIN ce USING (profile_id)"""


def merge_edits(spark: SparkSession, d: str) -> DataFrame:
    """Every document with edited lists: a job gone and one new, a skill gone and one new, no project, interests added, education untouched."""
    cvs = X.cvs(spark, d)
    view = E.recap(cvs)
    job = F.struct(F.lit("New").alias("role"), F.lit("—").alias("company"), F.lit(" did it ").alias("summary"), F.lit("2020").alias("start"), F.lit("Present").alias("end"))
    without_first = lambda c: F.filter(c, lambda _, i: i > 0)
    edits = view.withColumns(
        {
            "experiences": F.concat(without_first("experiences"), F.array(job)),
            "skills": F.concat(without_first("skills"), F.array(F.struct(F.lit("new skill").alias("name"), F.lit(65).alias("confidence")))),
            "projects": F.filter("projects", lambda _: F.lit(False)),
            "interests": F.concat("interests", F.array(F.lit("a, b;A"))),
            "educations": F.when(F.lit(False), F.col("educations")),
        }
    )
    x = E.merge_edits(cvs, edits)
    lines = lambda c, *names: F.array_join(F.transform(c, lambda e: F.concat_ws("/", *[F.coalesce(e[n].cast("string"), F.lit("-")) for n in names])), "|")
    jobs = F.transform("experience", lambda e: F.concat_ws("/", e["role"], e["organization"], F.array_join(e["core_responsibilities"], ";"), F.coalesce(e["industry"], F.lit("-")), e["start_date"], F.coalesce(e["end_date"], F.lit("-"))))
    return x.select(
        "profile_id",
        F.array_join(jobs, "|").alias("jobs"),
        lines("education", "degree_type", "institution", "start_date", "end_date").alias("education"),
        lines("certifications", "name", "issuing_organization", "issue_date", "credential_id").alias("certifications"),
        F.array_join(F.transform("skills_extracted.technical_skills", lambda s: F.concat_ws(":", s["name"], F.coalesce(s["proficiency"], F.lit("-")))), "|").alias("skills"),
        F.array_join("interests", ",").alias("interests"),
        F.size("projects").alias("n_projects"),
        F.size("skills_extracted.soft_skills").alias("n_soft"),
    )


MERGE_EDITS = f"""{PARTS},
n AS (SELECT profile_id, count(*) AS n FROM jobs GROUP BY 1),
place AS (SELECT profile_id, n, unnest(range(1, n + 1)) AS i FROM n),
merged AS (
  SELECT p.profile_id, i, CASE WHEN i < n THEN e.role ELSE 'New' END || '/' || CASE WHEN i < n THEN e.organization ELSE '—' END || '/' || CASE WHEN i < n THEN e.summary ELSE 'did it' END
    || '/' || b.industry || '/' || CASE WHEN i < n THEN e.start_date ELSE '2020' END || '/-' AS line
  FROM place p JOIN jobs b ON b.profile_id = p.profile_id AND b.ord = i LEFT JOIN jobs e ON e.profile_id = p.profile_id AND e.ord = i + 1),
ex AS (SELECT profile_id, string_agg(line, '|' ORDER BY i) AS jobs FROM merged GROUP BY 1),
ce AS (SELECT profile_id, string_agg(cert || '/Board/2019/id-1', '|' ORDER BY ord) AS certifications FROM profile_certs GROUP BY 1)
SELECT h.profile_id, coalesce(jobs, 'New/—/did it/-/2020/-') AS jobs, degree_type || '/' || institution || '/Oct 2012/Present' AS education, coalesce(certifications, '') AS certifications,
  concat_ws('|', rest, 'new skill:-') AS skills, array_to_string(list_concat({SHOWN}, ['a', 'b']), ',') AS interests, 0 AS n_projects, 2 AS n_soft
FROM heads h JOIN profiles USING (profile_id) LEFT JOIN sk USING (profile_id) LEFT JOIN ex USING (profile_id) LEFT JOIN ce USING (profile_id)"""

QUERIES = {
    "apply_edits": (apply_edits, APPLY_EDITS),
    "recap_view": (recap_view, RECAP_VIEW),
    "merge_edits": (merge_edits, MERGE_EDITS),
}
