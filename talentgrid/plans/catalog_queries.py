"""Catalog scans, joins, maintenance and vector search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..operators import catalog as K
from ..operators import numbering as N
from ..operators import pairs as B
from ..operators import prepared as P
from ..operators import tables as M
from ..sources import standins as X
from ..sources.tables import table
from .text_queries import sql_key


def outer_join_residual(spark: SparkSession, d: str) -> DataFrame:
    """Every role, with the salary of one region only (a constant in the outer join's condition)."""
    r = X.roles(spark, d)
    pay = r.filter("region = 'EUROPE'").select("role_id", F.col("balance").alias("monthly"))
    return r.select("role_id", "title").join(pay, "role_id", "left").select("role_id", "title", S.salary_text(F.col("monthly")).alias("salary"))


OUTER_JOIN_RESIDUAL = f"""WITH {X.SQL['roles']}
SELECT r.role_id, r.title, coalesce('EUR ' || round_even(s.balance * 12 / 1000, 0)::BIGINT || 'k', '') AS salary
FROM roles r LEFT JOIN roles s ON r.role_id = s.role_id AND s.region = 'EUROPE'"""


def lateral_first_part(spark: SparkSession, d: str) -> DataFrame:
    """One part per supplier: the dearest it ships, ties by key; suppliers without parts stay."""
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice")
    best = li.join(p, li.l_partkey == p.p_partkey).groupBy("l_suppkey").agg(F.min(F.struct(-F.col("p_retailprice"), F.col("p_partkey"), F.col("p_name"))).alias("b"))
    s = table(spark, d, "supplier")
    return s.join(best, s.s_suppkey == best.l_suppkey, "left").select(F.col("s_suppkey").alias("role_id"), F.col("b.p_partkey").alias("part"), F.col("b.p_name").alias("name"))


LATERAL_FIRST_PART = """
SELECT s_suppkey AS role_id, x.p_partkey AS part, x.p_name AS name FROM supplier LEFT JOIN (
  SELECT l_suppkey, p_partkey, p_name FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN part ON l_partkey = p_partkey
  QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY p_retailprice DESC, p_partkey) = 1) x ON l_suppkey = s_suppkey"""


def role_skill_weights(spark: SparkSession, d: str) -> DataFrame:
    """The weighted skills of every role, with importance tiers."""
    return X.role_skills(spark, d).select("role_id", "skill", "domain", F.round("weight", 9).alias("weight"), "ord", S.importance(F.col("weight")).alias("importance"))


ROLE_SKILL_WEIGHTS = f"""WITH {X.SQL['role_skills']}
SELECT role_id, skill, domain, round(weight, 9) AS weight, ord::INT AS ord,
  CASE WHEN weight >= 0.75 THEN 'essential' WHEN weight >= 0.40 THEN 'important' ELSE 'nice_to_have' END AS importance FROM role_skills"""


def batch_role_scan(spark: SparkSession, d: str) -> DataFrame:
    """Roles with their distinct skills and brands as ordered lists."""
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    names = li.join(p, li.l_partkey == p.p_partkey).groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_set("p_name")), ", ").alias("skills"), F.array_join(F.array_sort(F.collect_set("p_brand")), ", ").alias("brands"))
    s = table(spark, d, "supplier")
    return s.join(names, s.s_suppkey == names.l_suppkey, "left").select(F.col("s_suppkey").alias("role_id"), F.col("s_name").alias("title"), "skills", "brands")


BATCH_ROLE_SCAN = """
SELECT s_suppkey AS role_id, s_name AS title, skills, brands FROM supplier LEFT JOIN (
  SELECT l_suppkey, string_agg(DISTINCT p_name, ', ' ORDER BY p_name) AS skills, string_agg(DISTINCT p_brand, ', ' ORDER BY p_brand) AS brands
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) ON l_suppkey = s_suppkey"""


def role_pages(spark: SparkSession, d: str) -> DataFrame:
    """The batch job's roles, by title and id, in pages of fifty."""
    return N.pages(X.roles(spark, d).select("role_id", "title", "region"), ["title", "role_id"], 50)


ROLE_PAGES = f"""WITH {X.SQL['roles']}, n AS (SELECT role_id, title, region, row_number() OVER (ORDER BY title, role_id) - 1 AS k FROM roles)
SELECT role_id, title, region, k // 50 + 1 AS page, (k % 50 + 1)::INT AS place FROM n"""


def order_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Gapless numbers of all orders by price, dearest first: an order that many rows share no value of."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return N.numbered(o, [F.desc("o_totalprice"), "o_orderkey"], "number")


ORDER_NUMBERS = "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS number FROM orders"


def explode_alias_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Comma lists split to rows, keyed, mapped through the alias table, made distinct."""
    raw = table(spark, d, "part").select("p_partkey", F.concat_ws(" , ", "p_name", F.upper("p_type"), "p_name").alias("raw"))
    names = table(spark, d, "part").select("p_name").distinct()
    alias = names.select(T.skill_key(F.col("p_name")).alias("alias_key"), F.element_at(F.split("p_name", " "), -1).alias("canonical")).filter("canonical <> 'ring'")
    rows = raw.select("p_partkey", F.explode(F.split("raw", r"\s*,\s*")).alias("skill")).withColumn("key", T.skill_key(F.col("skill")))
    return rows.join(alias, F.col("key") == F.col("alias_key"), "left").select("p_partkey", "skill", F.coalesce("canonical", "key").alias("key")).distinct()


EXPLODE_ALIAS_BACKFILL = f"""
WITH alias AS (SELECT DISTINCT {sql_key('p_name')} AS alias_key, string_split(p_name, ' ')[-1] AS canonical FROM part WHERE string_split(p_name, ' ')[-1] <> 'ring'),
r AS (SELECT p_partkey, unnest([p_name, upper(p_type), p_name]) AS skill FROM part)
SELECT DISTINCT p_partkey, skill, coalesce(canonical, {sql_key('skill')}) AS key FROM r LEFT JOIN alias ON alias_key = {sql_key('skill')}"""


def upsert_skills(spark: SparkSession, d: str) -> DataFrame:
    """Existing part rows, with new names for large ones and rows that did not exist."""
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    old = p.filter("p_size <= 30")
    new = p.filter("p_size >= 20").withColumn("p_name", F.upper("p_name"))
    return M.upsert(old, new, ["p_partkey"])


UPSERT_SKILLS = "SELECT p_partkey, CASE WHEN p_size >= 20 THEN upper(p_name) ELSE p_name END AS p_name, p_size FROM part"


def update_from_values(spark: SparkSession, d: str) -> DataFrame:
    """An update that keeps the old value where the new one is missing."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    new = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 25, F.concat("p_brand", F.lit("+"))).alias("p_brand"))
    return M.update_from(p, new, ["p_partkey"])


UPDATE_FROM_VALUES = "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_brand || '+' ELSE p_brand END AS p_brand, p_type FROM part"


def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Rows left in three tables after the parts of one type are deleted."""
    p, li = table(spark, d, "part"), table(spark, d, "lineitem")
    ids = p.filter("p_type = 'PROMO'").select("p_partkey")
    parent, kids = M.cascade_delete(p, {"lineitem": li.withColumnRenamed("l_partkey", "p_partkey").select("p_partkey", "l_quantity")}, ids, "p_partkey")
    a = parent.agg(F.count("*").alias("n")).select(F.lit("part").alias("name"), "n", F.lit(None).cast("double").alias("quantity"))
    return a.unionByName(kids["lineitem"].agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity")).select(F.lit("lineitem").alias("name"), "n", "quantity"))


DELETE_CASCADE = """
SELECT 'part' AS name, count(*) AS n, NULL::DOUBLE AS quantity FROM part WHERE p_type <> 'PROMO'
UNION ALL SELECT 'lineitem', count(*), sum(l_quantity) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO')"""


def catalog_count(spark: SparkSession, d: str) -> DataFrame:
    """Vectors per label, with their sizes."""
    return table(spark, d, "embeddings").filter("embedding is not null").groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dims"))


CATALOG_COUNT = "SELECT label, count(*) AS n, max(len(embedding))::INT AS dims FROM embeddings WHERE embedding IS NOT NULL GROUP BY 1"


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors of every vector whose id is divisible by 50, exactly.

    Queries and rows meet in cells; each names its own ten of every query before the final ranking, so
    no pairs are shuffled whole.  Vectors with a null in them are near none.
    """
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("role_id"), F.col("embedding").cast("array<double>").alias("v"))
    e = e.filter(F.col("role_id").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    near = B.nearest(e.filter(F.col("role_id") % 50 == 0).withColumnRenamed("role_id", "profile_id"), e, 10)
    rows = near.select(F.col("profile_id").alias("query"), F.col("role_id").alias("vec_id"), "similarity")
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "vec_id")
    return rows.withColumn("pos", F.row_number().over(w)).filter("pos <= 10").select("query", "vec_id", "similarity", "pos")


COSINE_TOPK = """
WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0),
r AS (SELECT query, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS similarity FROM embeddings, q)
SELECT query, vec_id, similarity, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id)::INT AS pos FROM r
QUALIFY row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id) <= 10"""


def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Roles by an id list, titles falling back when blank; ids without a role have none."""
    ids = spark.range(0, 12).select((F.col("id") * 11).alias("role_id"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("role_id"), F.coalesce(F.nullif(F.trim("s_name"), F.lit("")), F.lit("unknown")).alias("title"))
    return ids.join(s, "role_id", "left")


POINT_LOOKUP = "SELECT i.role_id, coalesce(nullif(trim(s_name), ''), CASE WHEN s_suppkey IS NOT NULL THEN 'unknown' END) AS title FROM (SELECT unnest(range(12)) * 11 AS role_id) i LEFT JOIN supplier ON s_suppkey = i.role_id"

def skill_maps(spark: SparkSession, d: str) -> DataFrame:
    """Weight, domain and display of every listed skill; some come twice."""
    x = X.sort_skills(spark, d)
    again = x.filter("ord <= 2").select("role_id", (F.col("ord") + 20).alias("ord"), F.concat(F.lit(" "), F.upper("skill")).alias("skill"), F.when(F.col("ord") == 1, " ").otherwise(" Other ").alias("domain"), F.when(F.col("ord") == 1, 0.5).alias("score"))
    return K.skill_maps(x.unionByName(again)).select("role_id", "key", "weight", "domain", "display", "ord")


SKILL_MAPS = f"""WITH {X.SQL['role_skills']}, {X.SQL['sort_skills']}
SELECT role_id, lower(skill) AS key, CASE WHEN ord = 1 THEN 0.5 ELSE score END::DOUBLE AS weight, CASE WHEN ord = 2 THEN 'Other' ELSE nullif(domain, '') END AS domain, skill AS display, ord::INT AS ord FROM sort_skills"""


def required_skill_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Required skills of every role from the first source that has any, as matching and as the gap report read them."""
    r = X.roles(spark, d).select("role_id")
    sorted_ = X.sort_skills(spark, d).filter("role_id % 7 not in (3, 5, 6)").select("role_id", "skill", "ord")
    listed = X.role_skills(spark, d).filter("role_id % 7 = 3").select("role_id", F.upper("skill").alias("skill"))
    r = r.withColumn("raw_skills", F.when(F.col("role_id") % 7 == 5, "API / Pandas;go|old-ring, Rest Api").when(F.col("role_id") % 7 == 3, "never read"))
    both = P.overlay(P.default_aliases(spark), P.clean_aliases(X.alias_rows(spark, d)))
    a = K.required_skills(r, sorted_, listed, both).select("role_id", "source", F.array_join("skills", ",").alias("matching"))
    b = K.required_skills(r, sorted_, listed, None).select("role_id", F.array_join("skills", ",").alias("gaps"))
    return a.join(b, "role_id")


REQUIRED_SKILL_CASCADE = f"""WITH {X.SQL['role_skills']}, {X.SQL['sort_skills']},
a AS (SELECT role_id, string_agg(lower(skill), ',' ORDER BY ord) AS s FROM sort_skills GROUP BY 1), b AS (SELECT role_id, string_agg(skill, ',' ORDER BY upper(skill)) AS s FROM role_skills GROUP BY 1)
SELECT r.role_id, CASE WHEN r.role_id % 7 = 3 AND b.s IS NOT NULL THEN 'role_skills' WHEN r.role_id % 7 = 5 THEN 'raw_skills' WHEN r.role_id % 7 = 6 OR a.s IS NULL THEN '' ELSE 'sort_skills' END AS source,
  CASE WHEN r.role_id % 7 = 3 THEN coalesce(b.s, '') WHEN r.role_id % 7 = 5 THEN 'rest apis,python,go,new ring' WHEN r.role_id % 7 = 6 THEN '' ELSE coalesce(a.s, '') END AS matching,
  CASE WHEN r.role_id % 7 = 3 THEN coalesce(b.s, '') WHEN r.role_id % 7 = 5 THEN 'API,Pandas,go,old-ring,Rest Api' WHEN r.role_id % 7 = 6 THEN '' ELSE coalesce(a.s, '') END AS gaps
FROM (SELECT s_suppkey AS role_id FROM supplier) r LEFT JOIN a USING (role_id) LEFT JOIN b USING (role_id)"""


def rank_role_skills(spark: SparkSession, d: str) -> DataFrame:
    """Skills of every role ranked by a written score and by likeness to its description; some replies are unusable."""
    s = X.role_skills(spark, d)
    item = F.struct("ord", F.struct(F.concat(F.lit(" "), "skill").alias("skill"), F.lit("x").alias("tier"), (F.col("weight") * 1.2).alias("score")).alias("i"))
    groups = s.groupBy("role_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["i"]).alias("items"))
    body = F.to_json(F.struct(F.lit(" Clean  Title ").alias("processed_job_title"), F.array(F.struct(F.lit(" Core ").alias("domain"), F.col("items").alias("skills"))).alias("skill_domains")))
    reply = F.when(F.col("role_id") % 4 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("role_id") % 4 == 2, F.replace(body, F.lit('"score"'), F.lit('"points"'))).otherwise(body)
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    n = e.count()
    r = X.roles(spark, d).select("role_id", (F.col("role_id") % n).alias("vec_id")).join(e, "vec_id").join(groups, "role_id")
    roles = r.select("role_id", F.when(F.col("role_id") % 4 == 3, " ; ").otherwise("a, b").alias("raw_skills"), reply.alias("reply"), F.col("embedding").alias("vector"))
    nodes = X.skill_nodes(spark, d).select("skill", "node")
    vectors = nodes.filter("node % 5 <> 4").join(e, F.col("node") == F.col("vec_id")).select("skill", F.col("embedding").alias("vector"))
    x = K.ranked_skills(roles, vectors)
    skills = F.transform("sort_skills", lambda t: F.concat_ws(":", t["skill"], t["domain"], F.format_string("%.4f", t["score"])))
    return x.select("role_id", F.coalesce("processed_title", F.lit("")).alias("title"), "failed", F.array_join(skills, "|").alias("ranked"))


RANK_ROLE_SKILLS = f"""WITH {X.SQL['role_skills']}, {X.SQL['edges']}, nvec AS (SELECT count(*) AS n FROM embeddings),
v AS (SELECT skill, embedding::DOUBLE[] AS sv FROM nodes JOIN embeddings ON vec_id = node WHERE node % 5 <> 4),
x AS (SELECT role_id, r.skill, ord, round(0.85::DOUBLE * least(1.0::DOUBLE, weight * 1.2::DOUBLE) + 0.15000000000000002::DOUBLE * CASE WHEN sv IS NULL THEN 0 ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, list_dot_product(e.embedding::DOUBLE[], sv))) END, 4) AS score
  FROM role_skills r, nvec, embeddings e LEFT JOIN v ON v.skill = r.skill WHERE e.vec_id = role_id % n AND role_id % 4 < 2)
SELECT role_id, CASE WHEN role_id % 4 < 2 THEN 'Clean  Title' ELSE '' END AS title, role_id % 4 = 2 AS failed, coalesce(ranked, '') AS ranked
FROM (SELECT DISTINCT role_id FROM role_skills) LEFT JOIN (SELECT role_id, string_agg(skill || ':Core:' || printf('%.4f', score), '|' ORDER BY score DESC, ord) AS ranked FROM x GROUP BY 1) USING (role_id)"""
RANK_ROLE_SKILLS = RANK_ROLE_SKILLS.replace("FROM role_skills r, nvec, embeddings e LEFT JOIN v ON v.skill = r.skill WHERE e.vec_id = role_id % n AND role_id % 4 < 2", "FROM role_skills r CROSS JOIN nvec JOIN embeddings e ON e.vec_id = role_id % n LEFT JOIN v ON v.skill = r.skill WHERE role_id % 4 < 2")


def esco_grounding(spark: SparkSession, d: str) -> DataFrame:
    """Official labels and texts for the first eight skills of every role."""
    missing = X.role_skills(spark, d).select("role_id", F.when(F.col("ord") % 3 == 0, F.substring_index("skill", " ", -1)).otherwise(F.col("skill")).alias("skill"), "ord")
    labels = table(spark, d, "part").select("p_name", "p_brand", "p_size").distinct()
    labels = labels.select(F.when(F.col("p_size") % 2 == 0, F.initcap("p_name")).otherwise(F.concat_ws(" ", "p_brand", "p_name")).alias("label"), F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("About "), "p_name")).alias("description"))
    labels = labels.groupBy("label").agg(F.max("description").alias("description"))
    return K.grounding(missing, labels)


ESCO_GROUNDING = f"""WITH {X.SQL['role_skills']},
labels AS (SELECT label, max(description) AS description FROM (SELECT CASE WHEN p_size % 2 = 0 THEN array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') ELSE p_brand || ' ' || p_name END AS label,
  CASE WHEN p_size % 3 <> 0 THEN 'About ' || p_name END AS description FROM part) GROUP BY 1),
m AS (SELECT role_id, CASE WHEN ord % 3 = 0 THEN string_split(skill, ' ')[-1] ELSE skill END AS skill, ord FROM role_skills QUALIFY row_number() OVER (PARTITION BY role_id ORDER BY ord) <= 8),
h AS (SELECT skill, label, description FROM (SELECT DISTINCT skill FROM m), labels WHERE contains(lower(label), lower(skill))
  QUALIFY row_number() OVER (PARTITION BY skill ORDER BY lower(label) <> lower(skill), CASE WHEN lower(label) <> lower(skill) THEN length(label) ELSE 0 END, label) = 1)
SELECT role_id, skill, label, description FROM m JOIN h USING (skill) WHERE coalesce(description, '') <> ''"""


def role_prompts(spark: SparkSession, d: str) -> DataFrame:
    """What a model would be asked about the first fifty roles (a page of the batch job), in order of id."""
    raw = X.role_skills(spark, d).filter("role_id % 6 <> 5").groupBy("role_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "skill"))), lambda s: s["skill"]), " ; ").alias("raw"))
    page = X.roles(spark, d).orderBy("role_id").limit(50)  # the feature: a limited run of the batch
    x = page.join(raw, "role_id", "left")
    return x.select("role_id", F.md5(K.prompt(F.col("title"), F.col("description"), T.split_list(F.col("raw")), F.lit("Rank these skills."))).alias("prompt_md5"))


ROLE_PROMPTS = f"""WITH {X.SQL['role_skills']}, {X.SQL['roles']},
r AS (SELECT role_id, string_agg(skill, chr(10) ORDER BY ord) AS raw FROM role_skills WHERE role_id % 6 <> 5 GROUP BY 1)
SELECT role_id, md5('Rank these skills.' || chr(10) || chr(10) || 'ROLE TITLE: ' || title || chr(10) || 'ROLE DESCRIPTION: ' || trim(regexp_replace(description, '\\s+', ' ', 'g')) || chr(10) || 'RAW SKILLS:' || chr(10) || coalesce(raw, '(none provided)')) AS prompt_md5
FROM (SELECT * FROM roles ORDER BY role_id LIMIT 50) LEFT JOIN r USING (role_id)"""


def delete_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of three tables that a cascading delete of some orders would take."""
    o = table(spark, d, "orders").withColumnRenamed("o_orderkey", "key")
    ids = o.filter("o_orderstatus = 'P'").select("key")
    return K.delete_counts({"orders": o, "lineitem": table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "key")}, ids.union(ids), "key")


DELETE_COUNTS = """
SELECT 'orders' AS name, count(*) AS rows, count(*) FILTER (o_orderstatus = 'P') AS deleted FROM orders
UNION ALL SELECT 'lineitem', count(*), count(*) FILTER (o_orderstatus = 'P') FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey"""


def evolved_schema(spark: SparkSession, d: str) -> DataFrame:
    """Parts with added columns, without a dropped one; vectors are checked on the way."""
    e = K.checked_vectors(table(spark, d, "embeddings"), "embedding", 64)
    p = K.evolved(table(spark, d, "part"), {"capability_text": "string", "sort_skills": K.SORT_SKILLS, "p_size": "int"}, ("p_retailprice", "embedding"))
    x = p.join(e.select("vec_id", F.size("embedding").alias("dims")), F.col("p_partkey") == F.col("vec_id"), "left")
    return x.select("p_partkey", "p_size", F.col("capability_text").isNull().alias("new_is_null"), F.lit(",".join(p.columns)).alias("columns"), "dims")


EVOLVED_SCHEMA = "SELECT p_partkey, p_size, true AS new_is_null, 'p_partkey,p_name,p_brand,p_type,p_size,capability_text,sort_skills' AS columns, CASE WHEN vec_id IS NOT NULL THEN 64 END AS dims FROM part LEFT JOIN embeddings ON vec_id = p_partkey"

QUERIES = {
    "role_pages": (role_pages, ROLE_PAGES),
    "order_numbers": (order_numbers, ORDER_NUMBERS),
    "outer_join_residual": (outer_join_residual, OUTER_JOIN_RESIDUAL),
    "lateral_first_part": (lateral_first_part, LATERAL_FIRST_PART),
    "role_skill_weights": (role_skill_weights, ROLE_SKILL_WEIGHTS),
    "batch_role_scan": (batch_role_scan, BATCH_ROLE_SCAN),
    "explode_alias_backfill": (explode_alias_backfill, EXPLODE_ALIAS_BACKFILL),
    "upsert_skills": (upsert_skills, UPSERT_SKILLS),
    "update_from_values": (update_from_values, UPDATE_FROM_VALUES),
    "delete_cascade": (delete_cascade, DELETE_CASCADE),
    "catalog_count": (catalog_count, CATALOG_COUNT),
    "cosine_topk": (cosine_topk, COSINE_TOPK),
    "point_lookup": (point_lookup, POINT_LOOKUP),
    "skill_maps": (skill_maps, SKILL_MAPS),
    "required_skill_cascade": (required_skill_cascade, REQUIRED_SKILL_CASCADE),
    "rank_role_skills": (rank_role_skills, RANK_ROLE_SKILLS),
    "esco_grounding": (esco_grounding, ESCO_GROUNDING),
    "role_prompts": (role_prompts, ROLE_PROMPTS),
    "delete_counts": (delete_counts, DELETE_COUNTS),
    "evolved_schema": (evolved_schema, EVOLVED_SCHEMA),
}
