"""JSON sources: the skill ontology and evaluation fixtures, as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

NODE = "struct<name:string,synonyms:array<string>,impliesKnowingSkills:array<string>,technicalDomains:array<string>,associatedToApplicationDomains:array<string>>"
PROFILES = "struct<profiles:array<struct<name:string,judged_roles:array<struct<role_id:string,title:string,relevance:int,expected_bucket:string>>>>>"


def ontology(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``nodes`` (name, domains), ``names`` (key, name, domains) and ``edges`` (src, dst) of an ontology file.

    The file holds a list of nodes, or an object of them; where two nodes claim a key, the last
    counts.  Ends of edges are names where the ontology knows them, else as written.
    """
    raw = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    listed = raw.filter(F.col("v").startswith("[")).select(F.posexplode(F.from_json("v", f"array<{NODE}>")).alias("ord", "n"))
    keyed = raw.filter(~F.col("v").startswith("[")).select(F.posexplode(F.map_values(F.from_json("v", f"map<string,{NODE}>"))).alias("ord", "n"))
    empty = F.array().cast("array<string>")
    x = listed.unionByName(keyed).select("ord", "n.*").filter("coalesce(name, '') <> ''")
    hints = F.filter(F.concat(F.coalesce("technicalDomains", empty), F.coalesce("associatedToApplicationDomains", empty)), lambda d: F.coalesce(d, F.lit("")) != "")
    x = x.withColumn("domains", F.array_distinct(hints))
    last = x.groupBy("name").agg(F.max_by(F.struct("domains", "impliesKnowingSkills"), "ord").alias("n"))
    keys = x.select("ord", "name", F.explode(F.concat(F.coalesce("synonyms", empty), F.array("name"))).alias("k")).select("ord", "name", T.skill_key(F.col("k")).alias("key")).filter("key <> ''")
    nodes = last.select("name", "n.domains")
    names = keys.groupBy("key").agg(F.max_by("name", F.struct("ord", "name")).alias("name")).join(nodes, "name").select("key", "name", "domains")
    ends = last.select(F.col("name").alias("src"), F.explode("n.impliesKnowingSkills").alias("to")).withColumn("_k", T.skill_key(F.col("to")))
    edges = ends.join(names.select(F.col("key").alias("_k"), F.col("name").alias("_n")), "_k", "left").select("src", F.coalesce("_n", "to").alias("dst")).distinct()
    return {"nodes": nodes, "names": names, "edges": edges}


def judgements(spark: SparkSession, path: str) -> DataFrame:
    """(query, role_id, title, relevance, expected_bucket, ord) of a fixture file of judged profiles."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", PROFILES).alias("f"))
    return raw.select(F.explode("f.profiles").alias("p")).select(F.col("p.name").alias("query"), F.posexplode("p.judged_roles").alias("ord", "j")).select("query", "j.*", "ord")
