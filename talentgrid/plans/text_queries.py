"""Text-key, profile and JSON operators over the wide text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import table

KEY = "trim(regexp_replace(lower(replace(coalesce({x},''),'ß','ss')),'[^a-z0-9+#]+',' ','g'))"


def sql_key(x: str) -> str:
    return KEY.format(x=x)


def norm_key_documents(spark: SparkSession, d: str) -> DataFrame:
    """Skill, compact and certification keys of every document text."""
    x = table(spark, d, "documents").select("doc_id", T.bind(T.skill_key(F.col("text")), T.keys_of).alias("k"))
    return x.select("doc_id", *[F.md5(f"k.{c}").alias(f"{c}_key") for c in ("skill", "compact", "cert")])


NORM_KEY_DOCUMENTS = f"""
SELECT doc_id, md5({sql_key('text')}) AS skill_key,
       md5(regexp_replace(lower(replace(coalesce(text,''),'ß','ss')),'[^a-z0-9+#]+','','g')) AS compact_key,
       md5(trim(regexp_replace(lower(replace(coalesce(text,''),'ß','ss')),'[^a-z0-9]+',' ','g'))) AS cert_key
FROM documents"""

CLEAN = r"nullif(trim(regexp_replace({x}, '[ \t\n\r\f\x0b]+', ' ', 'g')), '')"


def truncate_text(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned texts cut at 700 and 1200 characters."""
    both = lambda c: F.struct(T.cut_words(c, 700).alias("short_text"), F.length(T.cut_words(c, 1200)).alias("long_length"))
    return table(spark, d, "documents").select("doc_id", T.bind(T.clean_text(F.col("text")), both).alias("x")).select("doc_id", "x.*")


def _sql_cut(n: int) -> str:
    return f"CASE WHEN length(c) > {n} THEN regexp_replace(substr(c, 1, {n}), ' [^ ]*$', '') || ' ...' ELSE c END"


TRUNCATE_TEXT = f"""SELECT doc_id, {_sql_cut(700)} AS short_text, length({_sql_cut(1200)})::INT AS long_length
FROM (SELECT doc_id, {CLEAN.format(x='text')} AS c FROM documents)"""


def card_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Two-sentence summaries of at most 180 characters."""
    return table(spark, d, "documents").select("doc_id", T.card_summary(F.col("text")).alias("summary"))


CARD_SUMMARIES = f"""
WITH c AS (SELECT doc_id, {CLEAN.format(x='text')} AS c FROM documents),
s AS (SELECT doc_id, trim(CASE WHEN regexp_extract(c || ' ', '^((?:.*?[.!?] ){{1,2}})', 1) <> '' THEN regexp_extract(c || ' ', '^((?:.*?[.!?] ){{1,2}})', 1) ELSE c END) AS s FROM c)
SELECT doc_id, CASE WHEN length(s) > 180 THEN regexp_replace(regexp_replace(substr(s, 1, 177), ' [^ ]*$', ''), '[ ,;:\\-]+$', '') || '...' ELSE s END AS summary FROM s"""


def keyword_domains(spark: SparkSession, d: str) -> DataFrame:
    """Career domains named in every conversation turn."""
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.keyword_domains(F.col("text")), ",").alias("domains"))


def sql_domains(k: str) -> str:
    """Domains of a padded key, as a list."""
    cases = []
    for name, words in T.DOMAIN_WORDS.items():
        cond = " OR ".join(f"contains(k, ' {w} ')" for w in words)
        cases.append(f"CASE WHEN {cond} THEN '{name}' END")
    return f"list_transform([{k}], lambda k: list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL))[1]"


def sql_terms(texts: str) -> str:
    """Distinct domain words and pairs of a list of texts."""
    stops = ", ".join(f"'{w}'" for w in T.DOMAIN_STOPS)
    key = sql_key("replace(coalesce(t, ''), '_', ' ')")
    words = f"list_filter(string_split({key}, ' '), lambda w: length(w) > 3 AND w NOT IN ({stops}))"
    return f"list_distinct(flatten(list_transform({texts}, lambda t: list_transform([{words}], lambda w: list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))[1])))"


KEYWORD_DOMAINS = f"SELECT conv_id, turn, array_to_string({sql_domains('k')}, ',') AS domains FROM (SELECT conv_id, turn, ' ' || {sql_key('text')} || ' ' AS k FROM conversations)"


def json_props(spark: SparkSession, d: str) -> DataFrame:
    """Typed JSON fields of every event, malformed JSON as null."""
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int").getField("k").alias("k"), F.get_json_object("props", "$.k").alias("k_text"))


JSON_PROPS = "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INT) AS k, json_extract_string(props, '$.k') AS k_text FROM events"


def split_lists(spark: SparkSession, d: str) -> DataFrame:
    """Delimited lists split, trimmed and made distinct in order: the words of part names by type."""
    raw = F.concat_ws(", ", "p_name", F.upper("p_name"), "p_brand", "p_type", "p_brand")
    return table(spark, d, "part").select("p_partkey", F.array_join(T.split_list(raw), "|").alias("skills"))


SPLIT_LISTS = """
WITH e AS (SELECT p_partkey, unnest([p_name, upper(p_name), p_brand, p_type, p_brand]) AS v, unnest([1,2,3,4,5]) AS i FROM part),
f AS (SELECT *, row_number() OVER (PARTITION BY p_partkey, lower(trim(v)) ORDER BY i) AS rn FROM e)
SELECT p_partkey, string_agg(v, '|' ORDER BY i) AS skills FROM f WHERE rn = 1 GROUP BY 1"""


def listify_json(spark: SparkSession, d: str) -> DataFrame:
    """Lists that come as JSON arrays or as delimited text."""
    raw = F.when(F.col("p_partkey") % 2 == 0, F.to_json(F.array("p_name", "p_type"))).otherwise(F.concat_ws("/", "p_name", "p_type", "p_name"))
    return table(spark, d, "part").select("p_partkey", F.array_join(T.listify(raw), "|").alias("items"))


LISTIFY_JSON = "SELECT p_partkey, CASE WHEN lower(p_name) = lower(p_type) THEN p_name ELSE p_name || '|' || p_type END AS items FROM part"


def seniority(spark: SparkSession, d: str) -> DataFrame:
    """Level in a title built from order priority and status, against a level by price."""
    o = table(spark, d, "orders")
    words = F.when(F.col("o_orderstatus") == "F", "Senior").when(F.col("o_orderstatus") == "O", "Jr.").otherwise("Team Lead")
    title = F.concat_ws(" ", words, F.lit("Engineer"))
    level = F.when(F.col("o_totalprice") > 300000, "principal").when(F.col("o_totalprice") > 150000, "mid")
    user = T.seniority_level(title)
    label, fit = T.seniority_gap(user, level)
    return o.select("o_orderkey", user.alias("user_level"), label.alias("label"), F.round(fit, 6).alias("fit"))


SENIORITY = """
WITH t AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'senior' WHEN 'O' THEN 'junior' ELSE 'lead' END AS u,
  CASE WHEN o_totalprice > 300000 THEN 'principal' WHEN o_totalprice > 150000 THEN 'mid' END AS r FROM orders),
x AS (SELECT *, list_position(['intern','junior','mid','senior','lead','staff','principal','director'], r)
  - list_position(['intern','junior','mid','senior','lead','staff','principal','director'], u) AS d FROM t)
SELECT o_orderkey, u AS user_level,
  CASE WHEN r IS NULL THEN 'unknown' WHEN d = 0 THEN 'match' WHEN d > 0 THEN 'stretch' ELSE 'overqualified' END AS label,
  round(CASE WHEN r IS NULL THEN 0.70::DOUBLE WHEN d = 0 THEN 1.0::DOUBLE WHEN d > 0 THEN greatest(0.25, 0.65 - 0.20 * (d - 1))::DOUBLE ELSE greatest(0.75, 0.90 - 0.05 * (abs(d) - 1))::DOUBLE END, 6) AS fit FROM x"""


def pii_filter(spark: SparkSession, d: str) -> DataFrame:
    """Documents that, taken as free items, speak of personal data."""
    x = table(spark, d, "documents")
    label = F.when(F.col("doc_id") % 9 == 0, "Date of Birth").when(F.col("doc_id") % 9 == 1, "Web site")
    section = F.when(F.col("doc_id") % 7 == 0, "CONTACT").otherwise(F.col("source"))
    return x.select("doc_id", T.is_pii(label, section, F.col("lang"), F.col("text")).alias("pii"))


PII_FILTER = """SELECT doc_id, doc_id % 9 = 0 OR doc_id % 7 = 0 OR contains(lower(coalesce(text, '')), 'http://') OR contains(lower(coalesce(text, '')), 'https://') OR contains(coalesce(text, ''), '@') AS pii FROM documents"""


def dynamic_terms(spark: SparkSession, d: str) -> DataFrame:
    """Domain words and their adjacent pairs, per benchmark item."""
    terms = T.domain_terms(F.array(F.col("text"), F.lit("senior_data the  engineer builds Data")))
    return table(spark, d, "benchmark").select("item_id", terms.alias("t")).select("item_id", F.size("t").alias("n_terms"), F.array_join(F.array_sort("t"), "|").alias("terms"))


DYNAMIC_TERMS = f"""
WITH t AS (SELECT item_id, {sql_terms("[text, 'senior_data the  engineer builds Data']")} AS t FROM benchmark)
SELECT item_id, len(t)::INT AS n_terms, array_to_string(list_sort(t), '|') AS terms FROM t"""


def label_keys(spark: SparkSession, d: str) -> DataFrame:
    """Levels of labels, certification groups, safe names, plain texts and JSON-or-text of part fields."""
    x = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size", (F.col("p_partkey") % 6).alias("k"))
    label = F.when(F.col("k") == 0, " Sr ").when(F.col("k") == 1, "LEAD").when(F.col("k") == 2, "tech lead").when(F.col("k") == 3, "wizard").when(F.col("k") == 4, "")
    cert = F.when(F.col("k") == 0, "CompTIA A+").when(F.col("k") == 1, "comptia  a plus").when(F.col("k") == 2, "OCA - Java").when(F.col("k") == 3, "--").otherwise(F.col("p_brand"))
    degree = F.when(F.col("k") == 0, "M.Sc. in Data-Science").when(F.col("k") == 1, "BSc Physics").when(F.col("k") == 2, "B. Eng, Civil").otherwise(F.col("p_name"))
    raw = F.when(F.col("k") == 0, F.lit('{"a": 1}')).when(F.col("k") == 1, F.lit("[1, 2]")).otherwise(F.concat(F.lit('say "'), "p_name", F.lit('"')))
    time = F.when(F.col("k") == 0, "3 Weeks").when(F.col("k") == 1, "2 months").when(F.col("k") == 2, "1 month").when(F.col("k") == 3, "9 weeks").otherwise("soon")
    period = T.date_range(F.lit("May 2012"), F.when(F.col("k") == 0, "Present").when(F.col("k") == 1, "2012").otherwise("12/2019"))
    return x.select(
        "p_partkey",
        T.level_of_label(label).alias("level"),
        T.certification_group(cert).alias("cert"),
        T.safe_name(F.concat(F.lit(" a/b: "), "p_brand", F.lit("?"))).alias("file"),
        T.plain_text(degree).alias("degree"),
        T.json_or_text(raw).alias("json"),
        T.timeline_text(time, F.lit("4 weeks")).alias("time"),
        period.alias("period"),
        T.shown_year(F.when(F.col("k") == 0, "since 1999").when(F.col("k") == 1, "—").when(F.col("k") == 2, "Present").otherwise("spring")).alias("year"),
        T.percent_text(F.when(F.col("k") > 0, F.col("k") / 8)).alias("percent"),
        T.first_text(F.lit(" "), F.when(F.col("k") == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit(" x  "), "p_name")), F.lit("none")).alias("first"),
    )


LABEL_KEYS = """
SELECT p_partkey, CASE k WHEN 0 THEN 'senior' WHEN 1 THEN 'lead' WHEN 2 THEN 'lead' END AS level,
  CASE k WHEN 0 THEN 'group 2' WHEN 1 THEN 'group 2' WHEN 2 THEN 'group 1' WHEN 3 THEN '' ELSE replace(lower(p_brand), '#', ' ') END AS cert, 'a_b_' || replace(p_brand, '#', '_') AS file,
  CASE k WHEN 0 THEN 'master science in data science' WHEN 1 THEN 'bachelor science physics' WHEN 2 THEN 'bachelor engineering civil' ELSE p_name END AS degree,
  CASE k WHEN 0 THEN '{"a": 1}' WHEN 1 THEN '[1, 2]' ELSE '"say \\"' || p_name || '\\""' END AS json,
  CASE k WHEN 0 THEN '3 weeks' WHEN 1 THEN '2 months' WHEN 2 THEN '4 weeks' WHEN 3 THEN '3 months' ELSE '4 weeks' END AS time,
  CASE k WHEN 0 THEN '2012 present' WHEN 1 THEN '2012' ELSE '2012 2019' END AS period, CASE k WHEN 0 THEN '1999' WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE 'spring' END AS year,
  CASE WHEN k > 0 THEN printf('%.1f%%', k / 8 * 100) ELSE '-' END AS percent, CASE WHEN k = 0 THEN 'none' ELSE 'x ' || p_name END AS first
FROM (SELECT *, p_partkey % 6 AS k FROM part)"""


def missing_sections(spark: SparkSession, d: str) -> DataFrame:
    """Roles that a conversation has no text for."""
    x = table(spark, d, "conversations").groupBy("conv_id").agg(*[F.max(F.when((F.col("role") == r) & (F.trim("text") != ""), 1).otherwise(0)).alias(r) for r in ("system", "user", "assistant")])
    gone = F.array_compact(F.array(*[F.when(F.col(r) == 0, F.lit(r)) for r in ("system", "user", "assistant")]))
    return x.select("conv_id", F.array_join(gone, ",").alias("missing"))


MISSING_SECTIONS = """
WITH h AS (SELECT conv_id, max((role='system' AND trim(text)<>'')::INT) s, max((role='user' AND trim(text)<>'')::INT) u, max((role='assistant' AND trim(text)<>'')::INT) a FROM conversations GROUP BY 1)
SELECT conv_id, array_to_string(list_filter([CASE WHEN s=0 THEN 'system' END, CASE WHEN u=0 THEN 'user' END, CASE WHEN a=0 THEN 'assistant' END], lambda x: x IS NOT NULL), ',') AS missing FROM h"""


def content_key_cache(spark: SparkSession, d: str) -> DataFrame:
    """Content-keyed preparation: one row per distinct text, with its first document."""
    x = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_key"))
    return x.groupBy("content_key").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n_docs"))


CONTENT_KEY_CACHE = "SELECT sha256(coalesce(text,'')) AS content_key, min(doc_id) AS first_doc, count(*) AS n_docs FROM documents GROUP BY 1"


def latest_role(spark: SparkSession, d: str) -> DataFrame:
    """First non-blank user text of each conversation, else its first text."""
    first = F.min_by("text", F.struct(F.when((F.col("role") == "user") & (F.trim("text") != ""), 0).otherwise(1), "turn"))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.md5(first).alias("title_md5"))


LATEST_ROLE = """
SELECT conv_id, md5(text) AS title_md5 FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN role='user' AND trim(text)<>'' THEN 0 ELSE 1 END, turn) = 1"""


def page_text_source(spark: SparkSession, d: str) -> DataFrame:
    """Pages as a text source: tags dropped, blank pages marked as unreadable."""
    plain = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), "[ \\t\\n\\r]+", " "))
    return table(spark, d, "pages").select("page_id", F.md5(plain).alias("text_md5"), F.length(plain).alias("n"), (plain == "").alias("unreadable"))


PAGE_TEXT_SOURCE = r"""
SELECT page_id, md5(p) AS text_md5, length(p)::INT AS n, p = '' AS unreadable FROM (
SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')) AS p FROM pages)"""


def capability_text(spark: SparkSession, d: str) -> DataFrame:
    """Embedding input of each conversation: numbered lines of its turns, cut at 700 characters."""
    x = table(spark, d, "conversations").withColumn("line", F.concat(F.lit("Turn "), (F.col("turn") + 1).cast("string"), F.lit(": "), T.truncate_words(F.col("text"), 700)))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda s: s["line"])
    return x.groupBy("conv_id").agg(F.md5(F.array_join(lines, "\n")).alias("text_md5"))


CAPABILITY_TEXT = f"""
SELECT conv_id, md5(string_agg('Turn ' || (turn + 1) || ': ' || ({_sql_cut(700)}), chr(10) ORDER BY turn)) AS text_md5
FROM (SELECT conv_id, turn, {CLEAN.format(x='text')} AS c FROM conversations) GROUP BY 1"""

QUERIES = {
    "norm_key_documents": (norm_key_documents, NORM_KEY_DOCUMENTS),
    "truncate_text": (truncate_text, TRUNCATE_TEXT),
    "card_summaries": (card_summaries, CARD_SUMMARIES),
    "keyword_domains": (keyword_domains, KEYWORD_DOMAINS),
    "json_props": (json_props, JSON_PROPS),
    "split_lists": (split_lists, SPLIT_LISTS),
    "listify_json": (listify_json, LISTIFY_JSON),
    "seniority": (seniority, SENIORITY),
    "pii_filter": (pii_filter, PII_FILTER),
    "dynamic_terms": (dynamic_terms, DYNAMIC_TERMS),
    "label_keys": (label_keys, LABEL_KEYS),
    "missing_sections": (missing_sections, MISSING_SECTIONS),
    "content_key_cache": (content_key_cache, CONTENT_KEY_CACHE),
    "latest_role": (latest_role, LATEST_ROLE),
    "page_text_source": (page_text_source, PAGE_TEXT_SOURCE),
    "capability_text": (capability_text, CAPABILITY_TEXT),
}
