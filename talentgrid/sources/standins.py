"""Career tables made from the star schema, so that every operator runs over whole tables.

Roles are suppliers; a role's skills are the names of the parts it ships, weighted by
quantity.  Profiles are the customers whose key is divisible by 50: the query set of the
matching searches, which grows with the data.  Their skills are the parts they order, their
experience is their latest orders.  The skill ontology is arithmetic on the ranks of skill names.
``SQL`` holds the same tables as named queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scoring import rounded
from ..operators.numbering import numbered
from ..scratch import dealt
from .derived import derived
from .tables import table

TOP_SKILLS = 10
EVERY = 50
SENIOR = ("Junior", "", "Senior", "Lead", "Principal")
WORK = ("Data Engineer", "Backend Developer", "Cloud Architect", "QA Tester", "Support Analyst", "Project Manager", "Security Engineer")
TAGS = ('["cloud", "backend"]', "data_analytics|support", "project_management, cloud")
LEVELS = ("Jr", "mid ", " Senior", "principal", "guru")


def pick(values: tuple[str, ...], k: Column) -> Column:
    """Element of a fixed list by a number from 0."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k + 1).cast("int"))


def title(k: Column) -> Column:
    """A job title by number."""
    return F.trim(F.concat(pick(SENIOR, k % 5), F.lit(" "), pick(WORK, k % 7)))


def roles(spark: SparkSession, d: str) -> DataFrame:
    """role_id, title, region, balance, description, domain_tags (three encodings)."""
    s, n, r = (table(spark, d, x) for x in ("supplier", "nation", "region"))
    place = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_nationkey", "r_name")  # 25 rows
    x = s.join(F.broadcast(place), s.s_nationkey == place.n_nationkey)
    name = title(F.col("s_suppkey"))
    text = F.concat(F.lit("The "), F.lower(name), F.lit(" builds  systems. Uses cloud and sql analysis! Reports to "), F.col("r_name"), F.lit("."))
    return x.select(F.col("s_suppkey").alias("role_id"), name.alias("title"), F.col("r_name").alias("region"), F.col("s_acctbal").alias("balance"), text.alias("description"), pick(TAGS, F.col("s_suppkey") % 3).alias("domain_tags"))


def _shipped(spark: SparkSession, d: str, part: DataFrame, *columns: str) -> DataFrame:
    """l_suppkey, l_quantity and columns of the part for every line item, dealt by l_suppkey to tasks of a bounded size."""
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    p = part.select("p_partkey", *columns).hint("merge")
    n = li.count()
    return dealt(dealt(li, n, "l_partkey").join(p, F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "l_quantity", *columns), n, "l_suppkey")


@derived
def role_skills(spark: SparkSession, d: str) -> DataFrame:
    """role_id, skill, domain, weight, ord: the ten most shipped part names of each role."""
    part = table(spark, d, "part")
    # the least type by its number: numbers are grouped by hash, texts by sorting every line item
    types = F.broadcast(numbered(part.select("p_type").distinct(), ["p_type"], "t"))  # a vocabulary, whatever the number of parts
    g = _shipped(spark, d, part.join(types, "p_type", "left"), "p_name", "t").groupBy("l_suppkey", "p_name").agg(F.sum("l_quantity").alias("q"), F.min("t").alias("t"))
    w = Window.partitionBy("l_suppkey")
    ranked = g.withColumn("ord", F.row_number().over(w.orderBy(F.desc("q"), "p_name"))).filter(F.col("ord") <= TOP_SKILLS)
    ranked = ranked.select(F.col("l_suppkey").alias("role_id"), F.col("p_name").alias("skill"), "t", (F.col("q") / F.max("q").over(w)).alias("weight"), "ord")
    return ranked.join(types.withColumnRenamed("p_type", "domain"), "t", "left").select("role_id", "skill", "domain", "weight", "ord")


def sort_skills(spark: SparkSession, d: str) -> DataFrame:
    """role_id, ord, skill (as displayed), domain ('' for the ninth), score (null for the tenth, and for every tenth role)."""
    x = role_skills(spark, d)
    shown = F.when(F.col("ord") % 2 == 0, F.upper("skill")).otherwise(F.col("skill"))
    score = F.when((F.col("role_id") % 10 != 9) & (F.col("ord") < 10), rounded(F.col("weight"), 4))
    return x.select("role_id", "ord", shown.alias("skill"), F.when(F.col("ord") == 9, "").otherwise(F.col("domain")).alias("domain"), score.alias("score"))


def profiles(spark: SparkSession, d: str) -> DataFrame:
    """profile_id, i (0, 1, ...), segment, nation."""
    c = table(spark, d, "customer").filter(F.col("c_custkey") % EVERY == 0)
    return c.select(F.col("c_custkey").alias("profile_id"), F.expr(f"c_custkey div {EVERY}").alias("i"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"))


def profile_orders(spark: SparkSession, d: str) -> DataFrame:
    """profile_id and its orders."""
    o = table(spark, d, "orders").filter(F.col("o_custkey") % EVERY == 0)
    return o.withColumnRenamed("o_custkey", "profile_id")


@derived
def profile_items(spark: SparkSession, d: str) -> DataFrame:
    """profile_id, l_orderkey, l_linenumber, l_quantity, p_name, p_brand: what the profiles ordered, from one pass over the line items."""
    o = profile_orders(spark, d).select("o_orderkey", "profile_id").hint("merge")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand").hint("merge")
    x = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    return x.select("profile_id", "l_orderkey", "l_linenumber", "l_quantity", "p_name", "p_brand")


@derived
def profile_skills(spark: SparkSession, d: str) -> DataFrame:
    """profile_id, skill, ord: the ten most ordered part names of each profile."""
    g = profile_items(spark, d).groupBy("profile_id", "p_name").agg(F.sum("l_quantity").alias("q"))
    w = Window.partitionBy("profile_id").orderBy(F.desc("q"), "p_name")
    return g.withColumn("ord", F.row_number().over(w)).filter("ord <= 10").select("profile_id", F.col("p_name").alias("skill"), "ord")


def explicit_terms(spark: SparkSession, d: str) -> DataFrame:
    """profile_id, term, ord: held skills as written, one of them twice."""
    x = profile_skills(spark, d).filter("ord <= 6")
    return x.select("profile_id", F.initcap("skill").alias("term"), "ord").unionByName(x.filter("ord = 1").select("profile_id", F.upper("skill").alias("term"), F.lit(7).alias("ord")))


def context_terms(spark: SparkSession, d: str) -> DataFrame:
    """profile_id, term, ord: sentences that mention further skills."""
    return profile_skills(spark, d).filter("ord > 6").select("profile_id", F.concat(F.lit("Built  the "), "skill", F.lit(" platform")).alias("term"), "ord")


def alias_rows(spark: SparkSession, d: str) -> DataFrame:
    """alias, canonical, ord: aliases with repeats (the last counts) and blanks."""
    old = table(spark, d, "part").select("p_name").distinct().filter("p_name like 'old %'")
    rest = F.substring_index("p_name", " ", -1)
    rows = old.select(F.upper("p_name").alias("alias"), F.concat(F.lit("red "), rest).alias("canonical"), F.lit(1).alias("ord"))
    rows = rows.unionByName(old.select(F.replace("p_name", F.lit(" "), F.lit("-")).alias("alias"), F.concat(F.lit("new "), rest).alias("canonical"), F.lit(2).alias("ord")))
    blank = spark.createDataFrame([("--", "blue gear", 3), ("blue bolt", "..", 4)], "alias string, canonical string, ord int")
    return rows.unionByName(blank)


@derived
def skill_nodes(spark: SparkSession, d: str) -> DataFrame:
    """node, skill, domains: the distinct part names by rank (a vocabulary, whatever the number of parts)."""
    names = table(spark, d, "part").groupBy(F.col("p_name").alias("skill")).agg(F.array_sort(F.collect_set("p_type")).alias("domains"))
    return numbered(names, ["skill"], "node", 0)


def skill_synonyms(spark: SparkSession, d: str) -> DataFrame:
    """key, name, domains: every key of every node."""
    n = skill_nodes(spark, d)
    own = n.select(F.col("skill").alias("key"), F.col("skill").alias("name"), "domains")
    other = n.filter("skill like 'cold %'").select(F.replace("skill", F.lit("cold "), F.lit("chilled ")).alias("key"), F.col("skill").alias("name"), "domains")
    return own.unionByName(other)


@derived
def skill_edges(spark: SparkSession, d: str) -> DataFrame:
    """src implies dst, as skill names."""
    n = skill_nodes(spark, d).select("skill", "node")
    size = n.count()
    pairs = n.select(F.col("skill").alias("src"), F.explode(F.array((F.col("node") * 2 + 1) % size, (F.col("node") * 3 + 2) % size)).alias("node"))
    return pairs.join(n, "node").select("src", F.col("skill").alias("dst")).filter("src <> dst").distinct()


def _cert(brand: Column, names: tuple[str, str]) -> Column:
    return F.when(brand == "Brand#1", names[0]).when(brand == "Brand#2", names[1]).otherwise(brand)


@derived
def role_certs(spark: SparkSession, d: str) -> DataFrame:
    """role_id, cert: the three most shipped brands of each role; every fifth role has none."""
    g = _shipped(spark, d, table(spark, d, "part"), "p_brand").filter(F.col("l_suppkey") % 5 != 4).groupBy(F.col("l_suppkey").alias("role_id"), "p_brand").agg(F.sum("l_quantity").alias("q"))
    w = Window.partitionBy("role_id").orderBy(F.desc("q"), "p_brand")
    return g.withColumn("rn", F.row_number().over(w)).filter("rn <= 3").select("role_id", _cert(F.col("p_brand"), ("CompTIA A+", "OCA Java")).alias("cert"))


@derived
def profile_certs(spark: SparkSession, d: str) -> DataFrame:
    """profile_id, cert, ord: the eight most ordered brands of each profile; every fifth profile has none."""
    x = profile_items(spark, d).filter(F.expr(f"profile_id div {EVERY} % 5 <> 4"))
    g = x.groupBy("profile_id", "p_brand").agg(F.sum("l_quantity").alias("q"))
    w = Window.partitionBy("profile_id").orderBy(F.desc("q"), "p_brand")
    return g.withColumn("ord", F.row_number().over(w)).filter("ord <= 8").select("profile_id", _cert(F.col("p_brand"), ("CompTIA A Plus", "Oracle Java Programmer Certification")).alias("cert"), "ord")


@derived
def experience(spark: SparkSession, d: str) -> DataFrame:
    """profile_id, ord and the fields of a profile's four latest jobs."""
    o = profile_orders(spark, d)
    w = Window.partitionBy("profile_id").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    o = o.withColumn("ord", F.row_number().over(w)).filter("ord <= 4")
    li = profile_items(spark, d).join(o.select("o_orderkey").hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    names = li.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "p_name"))), lambda s: s["p_name"]).alias("skills"))
    x = o.join(names.hint("merge"), o.o_orderkey == names.l_orderkey, "left")
    return x.select(
        "profile_id",
        "ord",
        F.when(F.col("o_orderstatus") == "P", "").otherwise(pick(WORK, F.col("o_orderkey") % 7)).alias("role"),
        F.concat(F.lit("Org "), (F.col("o_orderkey") % 10).cast("string")).alias("organization"),
        F.col("o_orderpriority").alias("industry"),
        F.date_format("o_orderdate", "yyyy").alias("start_date"),
        F.when(F.col("o_orderstatus") == "O", "Present").otherwise("").alias("end_date"),
        F.array(F.concat(F.lit("Handled  "), "o_orderpriority", F.lit(" orders")), F.lit("Wrote reports")).alias("core_responsibilities"),
        F.coalesce("skills", F.array().cast("array<string>")).alias("contextual_skills"),
    )


def heads(spark: SparkSession, d: str) -> DataFrame:
    """One row per profile: title, summary, level, years, direction, interests."""
    x = profiles(spark, d)
    i = F.col("i")
    return x.select(
        "profile_id",
        "i",
        "name",
        F.when(i % 6 == 5, "").otherwise(title(i)).alias("title"),
        F.when(i % 4 == 0, "").otherwise(F.concat(F.lit("Works in  "), F.lower("segment"), F.lit(" with machine learning,  sql and agile teams."))).alias("summary"),
        pick(LEVELS, i % 5).alias("level"),
        (i % 30).cast("int").alias("years"),
        F.when(i % 5 != 0, F.concat(F.lit("Towards "), pick(WORK, (i + 1) % 7))).alias("direction"),
        F.when(i % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.col("segment"), F.lit("cloud"), F.lit(" Cloud "), F.lit("ui design; hiking"))).alias("interests"),
        F.concat(F.lit("Uni "), F.col("nation").cast("string")).alias("institution"),
        pick(("BSc", "MSc", ""), i % 3).alias("degree_type"),
        pick(("Data", "", "Design"), i % 3).alias("field_of_study"),
    )


def cvs(spark: SparkSession, d: str) -> DataFrame:
    """One nested document per profile."""
    none = F.lit(None).cast("string")
    empty = F.array().cast("array<string>")
    job = F.struct("ord", "role", "organization", "industry", "start_date", "end_date", F.lit(12).alias("duration_months"), F.lit("Berlin").alias("location"), "core_responsibilities", "contextual_skills")
    jobs = experience(spark, d).groupBy("profile_id").agg(F.transform(F.array_sort(F.collect_list(job)), lambda s: s.dropFields("ord")).alias("experience"))
    held = profile_skills(spark, d).groupBy("profile_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "skill"))), lambda s: s["skill"]).alias("skills"))
    cert = F.struct("ord", F.col("cert").alias("name"), F.lit("Board").alias("issuing_organization"), F.lit("May 2019").alias("issue_date"), none.alias("expiration_date"), F.lit("id-1").alias("credential_id"))
    certs = profile_certs(spark, d).groupBy("profile_id").agg(F.transform(F.array_sort(F.collect_list(cert)), lambda s: s.dropFields("ord")).alias("certifications"))
    # both sides of a join grow with the profiles: none is sent to the driver
    x = heads(spark, d).join(jobs.hint("merge"), "profile_id", "left").join(held.hint("merge"), "profile_id", "left").join(certs.hint("merge"), "profile_id", "left")
    skills = F.coalesce("skills", empty)
    technical = F.transform(F.slice(skills, 1, 6), lambda s: F.struct(s.alias("name"), F.lit("expert").alias("proficiency")))
    soft = F.array(F.struct(F.lit("Teamwork ").alias("name"), F.lit(65.0).alias("confidence")), F.struct(F.lit("teamwork").alias("name"), F.lit(65.0).alias("confidence")))
    project = F.struct(F.concat(F.lit("Project "), F.col("i").cast("string")).alias("title"), F.lit("Org").alias("organization"), F.lit("lead").alias("role"), F.lit("").alias("description"), F.slice(skills, 1, 3).alias("technologies"), F.array(F.lit("Shipped it")).alias("outcomes"), F.array(F.lit("http://p")).alias("links"), F.lit("2020").alias("start_date"), none.alias("end_date"))
    item = lambda a, b, c, v: F.struct(F.lit(a).alias("label"), F.lit(b).alias("source_section"), F.lit(c).alias("reason_not_mapped"), F.lit(v).alias("value"))
    return x.select(
        "profile_id",
        F.struct(F.col("name").alias("full_name"), F.lit("a@b.c").alias("email"), F.lit("123").alias("phone"), F.nullif("title", F.lit("")).alias("current_role")).alias("personal_info"),
        F.struct("summary", F.col("level").alias("current_seniority_level"), F.col("years").alias("years_of_experience")).alias("profile_summary"),
        F.coalesce("experience", F.array().cast(jobs.schema["experience"].dataType)).alias("experience"),
        F.array(F.struct(F.lit("degree").alias("entry_type"), "degree_type", "field_of_study", "institution", F.lit("Oct 2012").alias("start_date"), F.lit("Present").alias("end_date"), F.lit("1.0").alias("grade"), F.array(F.lit("Databases")).alias("courses"))).alias("education"),
        F.array(project).alias("projects"),
        F.coalesce("certifications", F.array().cast(certs.schema["certifications"].dataType)).alias("certifications"),
        F.struct(technical.alias("technical_skills"), F.transform(F.slice(skills, 7, 1), lambda s: F.struct(s.alias("name"))).alias("inferred_skills"), soft.alias("soft_skills"), F.array(F.struct(F.lit("German").alias("language"), F.lit("C1").alias("level"))).alias("languages")).alias("skills_extracted"),
        "interests",
        F.col("direction").alias("potential_direction"),
        F.when(F.col("i") % 2 == 0, F.array(item("Home address", "Head", "none", "Street 1"), item("Hobby", "Other", "no field", "chess"))).otherwise(F.array(item("Note", "Other", "no field", "see HTTP://x.y"), item("Note", "Other", "no field", "likes tea"))).alias("unmapped_information"),
    )


def full_cvs(spark: SparkSession, d: str) -> DataFrame:
    """The documents with a thesis for two of three, the titles of theses in the education, and a place and links."""
    i = F.expr(f"profile_id div {EVERY}")
    names = F.transform("skills_extracted.technical_skills", lambda s: s["name"])
    none = F.lit(None).cast("string")
    thesis = F.struct(F.concat(F.lit("Thesis  "), i.cast("string")).alias("title"), F.lit("MSc").alias("degree_type"), F.lit("Uni T").alias("institution"), F.lit("Dr X").alias("supervisor"), F.when(i % 2 == 0, F.lit("On  graphs")).otherwise(none).alias("description"), F.concat(F.slice(names, 4, 2), F.array(F.lit("LaTeX"))).alias("technologies"), F.lit("1.3").alias("grade"))
    x = cvs(spark, d).withColumn("thesis", F.filter(F.array(thesis), lambda _: i % 3 != 1))
    x = x.withColumn("education", F.transform("education", lambda e: e.withField("thesis_title", F.when(i % 2 == 1, F.concat(F.lit("Title "), i.cast("string"))))))
    return x.withColumn("personal_info", F.col("personal_info").withField("location", F.lit("Berlin")).withField("links", F.array(F.lit("http://l"))))


def _sql_list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def sql_title(k: str) -> str:
    return f"trim({_sql_list(SENIOR)}[{k} % 5 + 1] || ' ' || {_sql_list(WORK)}[{k} % 7 + 1])"


SQL = {
    "role_skills": """role_skills AS (
  SELECT role_id, skill, domain, q / max(q) OVER (PARTITION BY role_id) AS weight, ord FROM (
    SELECT *, row_number() OVER (PARTITION BY role_id ORDER BY q DESC, skill) AS ord FROM (
      SELECT l_suppkey AS role_id, p_name AS skill, min(p_type) AS domain, sum(l_quantity) AS q
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)) WHERE ord <= 10)""",
    "sort_skills": """sort_skills AS (SELECT role_id, ord, CASE WHEN ord % 2 = 0 THEN upper(skill) ELSE skill END AS skill, CASE WHEN ord = 9 THEN '' ELSE domain END AS domain,
  CASE WHEN role_id % 10 <> 9 AND ord < 10 THEN round(weight, 4) END AS score FROM role_skills)""",
    "profiles": f"""profiles AS (SELECT c_custkey AS profile_id, c_custkey // {EVERY} AS i, c_mktsegment AS segment, c_nationkey AS nation, c_name AS name FROM customer WHERE c_custkey % {EVERY} = 0),
p_orders AS (SELECT *, o_custkey AS profile_id FROM orders WHERE o_custkey % {EVERY} = 0)""",
    "profile_skills": """profile_skills AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY q DESC, skill) AS ord FROM (
    SELECT profile_id, p_name AS skill, sum(l_quantity) AS q FROM lineitem JOIN p_orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)) WHERE ord <= 10),
explicit_terms AS (SELECT profile_id, array_to_string(list_transform(string_split(skill, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS term, ord FROM profile_skills WHERE ord <= 6
  UNION ALL SELECT profile_id, upper(skill), 7 FROM profile_skills WHERE ord = 1),
context_terms AS (SELECT profile_id, 'Built  the ' || skill || ' platform' AS term, ord FROM profile_skills WHERE ord > 6)""",
    "alias_rows": """old_names AS (SELECT DISTINCT p_name, string_split(p_name, ' ')[-1] AS last FROM part WHERE p_name LIKE 'old %'),
alias_rows AS (SELECT upper(p_name) AS alias, 'red ' || last AS canonical, 1 AS ord FROM old_names UNION ALL SELECT replace(p_name, ' ', '-'), 'new ' || last, 2 FROM old_names
  UNION ALL SELECT '--', 'blue gear', 3 UNION ALL SELECT 'blue bolt', '..', 4)""",
    "edges": """nodes AS (SELECT skill, domains, row_number() OVER (ORDER BY skill) - 1 AS node FROM (SELECT p_name AS skill, list_sort(list(DISTINCT p_type)) AS domains FROM part GROUP BY 1)),
synonyms AS (SELECT skill AS key, skill AS name, domains FROM nodes UNION ALL SELECT replace(skill, 'cold ', 'chilled '), skill, domains FROM nodes WHERE skill LIKE 'cold %'),
size AS (SELECT count(*) AS n FROM nodes),
edges AS (SELECT DISTINCT a.skill AS src, b.skill AS dst FROM nodes a, size, nodes b
  WHERE (b.node = (a.node * 2 + 1) % n OR b.node = (a.node * 3 + 2) % n) AND a.skill <> b.skill)""",
    "roles": f"""roles AS (SELECT s_suppkey AS role_id, {sql_title('s_suppkey')} AS title, r_name AS region, s_acctbal AS balance,
  'The ' || lower({sql_title('s_suppkey')}) || ' builds  systems. Uses cloud and sql analysis! Reports to ' || r_name || '.' AS description,
  {_sql_list(('cloud,backend', 'data_analytics,support', 'project_management,cloud'))}[s_suppkey % 3 + 1] AS tags
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "certs": f"""role_certs AS (SELECT role_id, CASE p_brand WHEN 'Brand#1' THEN 'CompTIA A+' WHEN 'Brand#2' THEN 'OCA Java' ELSE p_brand END AS cert FROM (
  SELECT l_suppkey AS role_id, p_brand, sum(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey % 5 <> 4 GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY role_id ORDER BY q DESC, p_brand) <= 3)),
profile_certs AS (SELECT profile_id, CASE p_brand WHEN 'Brand#1' THEN 'CompTIA A Plus' WHEN 'Brand#2' THEN 'Oracle Java Programmer Certification' ELSE p_brand END AS cert, ord FROM (
  SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY q DESC, p_brand) AS ord FROM (
  SELECT profile_id, p_brand, sum(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey JOIN p_orders ON l_orderkey = o_orderkey WHERE profile_id // {EVERY} % 5 <> 4 GROUP BY 1, 2)) WHERE ord <= 8)""",
    "experience": f"""exp0 AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY o_orderdate DESC, o_orderkey DESC) AS ord FROM p_orders QUALIFY ord <= 4),
experience AS (SELECT profile_id, ord, CASE WHEN o_orderstatus = 'P' THEN '' ELSE {_sql_list(WORK)}[o_orderkey % 7 + 1] END AS role, 'Org ' || (o_orderkey % 10) AS organization, o_orderpriority AS industry,
  strftime(o_orderdate, '%Y') AS start_date, CASE WHEN o_orderstatus = 'O' THEN 'Present' ELSE '' END AS end_date, ['Handled  ' || o_orderpriority || ' orders', 'Wrote reports'] AS resp, coalesce(skills, []) AS skills
  FROM exp0 LEFT JOIN (SELECT l_orderkey, list(p_name ORDER BY l_linenumber, p_name) AS skills FROM lineitem JOIN part ON l_partkey = p_partkey JOIN exp0 ON o_orderkey = l_orderkey GROUP BY 1) ON l_orderkey = o_orderkey)""",
    "heads": f"""heads AS (SELECT profile_id, i, name, CASE WHEN i % 6 = 5 THEN '' ELSE {sql_title('i')} END AS title,
  CASE WHEN i % 4 = 0 THEN '' ELSE 'Works in  ' || lower(segment) || ' with machine learning,  sql and agile teams.' END AS summary,
  {_sql_list(LEVELS)}[i % 5 + 1] AS level, (i % 30)::INT AS years, CASE WHEN i % 5 <> 0 THEN 'Towards ' || {_sql_list(WORK)}[(i + 1) % 7 + 1] END AS direction,
  CASE WHEN i % 3 = 0 THEN []::VARCHAR[] ELSE [segment, 'cloud', ' Cloud ', 'ui design; hiking'] END AS interests, 'Uni ' || nation AS institution, ['BSc', 'MSc', ''][i % 3 + 1] AS degree_type, ['Data', '', 'Design'][i % 3 + 1] AS field_of_study FROM profiles)""",
}
