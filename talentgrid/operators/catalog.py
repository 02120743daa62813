"""Building and reading the role catalogue: ranked skills, source cascades, grounding, schema and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..functions import text as T
from ..functions.scoring import clamp01, dot, rounded
from .ontology import first_by
from .prepared import canonical

#: Weight of the written score in a ranked skill; the rest is similarity to the description.
ALPHA = 0.85
REPLY = "struct<processed_job_title:string,skill_domains:array<struct<domain:string,skills:array<struct<skill:string,tier:string,score:double>>>>>"
SORT_SKILLS = "array<struct<skill:string,domain:string,score:double>>"
MAX_GROUNDING = 8


def parsed_reply(reply: Column) -> Column:
    """Struct of title and items (skill, domain, score) of a JSON reply, also inside a code fence; null if any part is unusable.

    Scores are clamped; a skill that comes twice has its last score and domain at its first place.
    """
    body = F.trim(F.regexp_replace(F.regexp_replace(F.trim(reply), "^`+(?i:json)?", ""), "`+$", ""))
    x = F.from_json(body, REPLY)

    def usable(g: Column) -> Column:
        items = F.forall(g["skills"], lambda i: (F.coalesce(F.trim(i["skill"]), F.lit("")) != "") & i["score"].isNotNull())
        return (F.coalesce(F.trim(g["domain"]), F.lit("")) != "") & F.coalesce(items, F.lit(False))

    def distinct(flat: Column, names: Column) -> Column:
        last = lambda i: F.element_at(F.filter(flat, lambda j: j["skill"] == i["skill"]), -1)
        return F.transform(F.filter(flat, lambda i, k: F.array_position(names, i["skill"]) == k + 1), last)

    def read(p: Column) -> Column:
        flat = F.flatten(F.transform(p["skill_domains"], lambda g: F.transform(g["skills"], lambda i: F.struct(F.trim(i["skill"]).alias("skill"), F.trim(g["domain"]).alias("domain"), clamp01(i["score"]).alias("score")))))
        # bound: each is read for every item
        items = T.bind(flat, lambda f: T.bind(F.transform(f, lambda i: i["skill"]), lambda names: distinct(f, names)))
        ok = F.forall(p["skill_domains"], usable)
        return F.when(ok, T.bind(items, lambda own: F.when(F.size(own) > 0, F.struct(F.nullif(F.trim(p["processed_job_title"]), F.lit("")).alias("title"), own.alias("items")))))

    return T.bind(x, read)


def ranked_skills(roles: DataFrame, vectors: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(role_id, processed_title, sort_skills, processed_skills, failed) of roles (role_id, raw_skills, reply, vector).

    A role without raw skills stays empty; one without a usable reply has failed.  ``vectors``:
    skill and vector, unit length; a skill without one counts as dissimilar.
    """
    x = roles.withColumns({"_any": F.size(T.split_list(F.col("raw_skills"))) > 0, "_p": parsed_reply(F.col("reply"))})
    rows = x.filter("_any and _p is not null").select("role_id", "vector", F.posexplode("_p.items").alias("ord", "i")).select("role_id", F.col("vector").alias("_v"), "ord", "i.*")
    rows = rows.join(vectors.select("skill", "vector"), "skill", "left")
    near = F.when(F.col("vector").isNotNull(), clamp01(dot(F.col("_v"), F.col("vector")))).otherwise(0.0)
    rows = rows.withColumn("score", rounded(F.lit(alpha) * F.col("score") + F.lit(1 - alpha) * near, 4))
    item = F.struct((-F.col("score")).alias("o"), "ord", "skill", "domain", "score")
    listed = rows.groupBy("role_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda s: F.struct(s["skill"].alias("skill"), s["domain"].alias("domain"), s["score"].alias("score"))).alias("sort_skills"))
    out = x.select("role_id", F.when(F.col("_any"), F.col("_p.title")).alias("processed_title"), (F.col("_any") & F.col("_p").isNull()).alias("failed")).join(listed, "role_id", "left")
    none = F.array().cast(SORT_SKILLS)
    return out.withColumn("sort_skills", F.coalesce("sort_skills", none)).withColumn("processed_skills", F.transform("sort_skills", lambda s: s["skill"]))


def failures(ranked: DataFrame) -> DataFrame:
    """One row: the ids of the roles that failed, in order, by commas; no row if none did."""
    ids = F.array_sort(F.collect_list(F.when(F.col("failed"), F.col("role_id"))))
    return ranked.agg(F.array_join(F.transform(ids, lambda i: i.cast("string")), ",").alias("ids")).filter("ids <> ''")


def prompt(title: Column, description: Column, raw_skills: Column, system: Column) -> Column:
    """The text that asks a model for a role's skills."""
    skills = F.array_join(raw_skills, "\n")
    return F.concat(system, F.lit("\n\nROLE TITLE: "), F.coalesce(T.clean_text(title), F.lit("")), F.lit("\nROLE DESCRIPTION: "), F.coalesce(T.truncate_words(description, 1200), F.lit("")), F.lit("\nRAW SKILLS:\n"), F.when(skills != "", skills).otherwise("(none provided)"))


def kept_rankings(old: DataFrame, ranked: DataFrame) -> DataFrame:
    """New rankings of roles; a role that failed keeps its old one (role_id, sort_skills)."""
    new = ranked.select("role_id", F.col("sort_skills").alias("_new"), "failed")
    x = old.join(new, "role_id", "left")
    return x.select("role_id", F.when(F.col("failed") | F.col("failed").isNull(), F.col("sort_skills")).otherwise(F.col("_new")).alias("sort_skills"))


def skill_maps(listed: DataFrame) -> DataFrame:
    """(role_id, key, weight, domain, display, ord) of listed skills (role_id, skill, domain, score, ord): last weight and domain, first display."""
    x = listed.withColumns({"key": T.skill_key(F.col("skill")), "domain": F.nullif(F.trim("domain"), F.lit(""))}).filter("key <> ''")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ord")))
    return x.groupBy("role_id", "key").agg(last("score").alias("weight"), last("domain").alias("domain"), F.min_by(F.trim("skill"), "ord").alias("display"), F.min("ord").alias("ord"))


def required_skills(roles: DataFrame, sorted_: DataFrame, listed: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """(role_id, source, skills) from the first source of a role that names any.

    ``sorted_``: role_id, skill, ord of ranked skills; ``listed``: role_id, skill of the role's
    skill table, in order of name; then the raw text of ``roles`` (role_id, raw_skills), with
    ``aliases`` as matching reads it, or as written (``None``) as the gap report does.
    """
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("ord", "key"))), lambda s: s["key"])

    def arrays(rows: DataFrame, name: str) -> DataFrame:
        first = rows.filter("key <> ''").groupBy("role_id", "key").agg(F.min("ord").alias("ord"))
        return first.groupBy("role_id").agg(in_order.alias(name))

    a = arrays(sorted_.select("role_id", T.skill_key(F.col("skill")).alias("key"), "ord"), "a")
    b = arrays(listed.select("role_id", T.skill_key(F.col("skill")).alias("key"), F.col("skill").alias("ord")), "b")
    raw = roles.select("role_id", F.posexplode(T.listify(F.col("raw_skills"))).alias("ord", "skill"))
    raw = raw.withColumn("key", F.col("skill")) if aliases is None else canonical(raw, T.skill_key(F.col("skill")), aliases)
    c = arrays(raw.select("role_id", "key", "ord"), "c")
    x = roles.select("role_id").join(a, "role_id", "left").join(b, "role_id", "left").join(c, "role_id", "left")
    source = F.when(F.col("a").isNotNull(), "sort_skills").when(F.col("b").isNotNull(), "role_skills").when(F.col("c").isNotNull(), "raw_skills").otherwise("")
    return x.select("role_id", source.alias("source"), F.coalesce("a", "b", "c", F.array().cast("array<string>")).alias("skills"))


def grounding(missing: DataFrame, labels: DataFrame, most: int = MAX_GROUNDING) -> DataFrame:
    """(role_id, skill, label, description): an official label and text for the first missing skills.

    ``missing``: role_id, skill, ord; ``labels``: label, description.  An equal label (in lower
    case) counts first, ties by label; else the shortest label that holds the skill.  Labels
    are found once per distinct skill, through its opening letters, which a label that holds it
    holds too.  Hits without a description are left out.
    """
    w = Window.partitionBy("role_id").orderBy("ord")
    asked = missing.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")
    skills = asked.select("skill").distinct().withColumn("s", F.lower("skill"))
    named = labels.withColumn("l", F.lower("label"))
    equal = skills.join(named, F.col("s") == F.col("l")).select("skill", "label", "description", F.lit(0).alias("tier"))
    gram = 3
    cut = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("l")), lambda i: F.substring(F.col("l"), i, F.lit(gram))))
    # every text of up to three letters is the beginning of some cut
    short = F.flatten(F.transform(cut, lambda c: F.array(c, F.substring(c, 1, 2), F.substring(c, 1, 1))))
    blocks = named.filter("l <> ''").withColumn("block", F.explode(F.array_distinct(short)))
    holds = skills.withColumn("block", F.substring("s", 1, gram)).join(blocks, "block").filter(F.contains(F.col("l"), F.col("s"))).select("skill", "label", "description", F.lit(1).alias("tier"))
    best = first_by(equal.unionByName(holds), ["skill"], ["tier", F.when(F.col("tier") == 1, F.length("label")).otherwise(0), "label"]).drop("tier")
    return asked.join(best.filter("coalesce(description, '') <> ''"), "skill").select("role_id", "skill", "label", "description")


def evolved(df: DataFrame, add: dict[str, DataType | str], drop: tuple[str, ...] = ()) -> DataFrame:
    """The table with columns of ``add`` that it lacks, as nulls, and without those of ``drop``."""
    new = {c: F.lit(None).cast(t) for c, t in add.items() if c not in df.columns}
    return df.withColumns(new).drop(*drop) if new else df.drop(*drop)


def checked_vectors(df: DataFrame, column: str, size: int) -> DataFrame:
    """The table, failing where a vector has another size; a missing column fails at once."""
    if column not in df.columns:
        raise ValueError(f"no column {column}")
    ok = F.col(column).isNull() | (F.size(column) == size)
    return df.withColumn(column, F.when(ok, F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"{column}: size is not {size} but "), F.size(column).cast("string")))))


def delete_counts(tables: dict[str, DataFrame], ids: DataFrame, key: str) -> DataFrame:
    """(name, rows, deleted) of each table: what a cascading delete of ``ids`` would take."""
    gone = ids.select(key).distinct().withColumn("_gone", F.lit(True))
    out = None
    for name, df in tables.items():
        one = df.select(key).join(gone, key, "left").agg(F.count("*").alias("rows"), F.count("_gone").alias("deleted")).select(F.lit(name).alias("name"), "rows", "deleted")
        out = one if out is None else out.unionByName(one)
    return out


def write_json(df: DataFrame, path: str) -> str:
    """The rows as JSON lines under ``path``."""
    df.write.mode("overwrite").json(path)
    return path


def write_text(df: DataFrame, path: str) -> str:
    """The only column as text under ``path``."""
    df.write.mode("overwrite").text(path)
    return path
