"""Alias maps and prepared skill profiles.

All lookups are joins on normalised keys: alias maps and the ontology's names are relations,
profiles are rows of terms.  One key holds once per profile: explicit terms before context
terms before what the ontology implies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .ontology import first_by, implied_with_hops

#: Skill aliases that hold unless a table of aliases says otherwise.
DEFAULT_ALIASES = {
    "api": "rest apis",
    "apis": "rest apis",
    "rest api": "rest apis",
    "restful api": "restful apis",
    "spring": "spring framework",
    "spring boot": "spring framework",
    "figma": "ui ux design",
    "ux": "ui ux design",
    "ui": "ui ux design",
    "accessibility": "web accessibility guidelines",
    "a11y": "web accessibility guidelines",
    "data": "data analysis",
    "analytics": "data analysis",
    "data analytics": "data analysis",
    "pandas": "python",
    "ci": "ci cd",
    "ci/cd": "ci cd",
    "continuous integration": "ci cd",
    "continuous integration ci": "ci cd",
    "automated testing": "test automation",
    "azure cloud": "azure",
    "linux services": "linux",
    "shell scripts": "scripting",
}


def clean_aliases(rows: DataFrame) -> DataFrame:
    """(key, canonical) of rows (alias, canonical, ord): both sides as keys, blanks dropped, the last row of a key counts."""
    x = rows.select(T.skill_key(F.col("alias")).alias("key"), T.skill_key(F.col("canonical")).alias("canonical"), "ord").filter("key <> '' and canonical <> ''")
    return x.groupBy("key").agg(F.max_by("canonical", F.struct("ord", "canonical")).alias("canonical"))


def default_aliases(spark: SparkSession) -> DataFrame:
    """The fixed aliases as (key, canonical)."""
    rows = [(a, c, i) for i, (a, c) in enumerate(DEFAULT_ALIASES.items())]
    return clean_aliases(spark.createDataFrame(rows, "alias string, canonical string, ord int"))


def overlay(base: DataFrame, own: DataFrame) -> DataFrame:
    """Aliases of both; where a key is in both, those of ``own`` hold."""
    return own.unionByName(base.join(own.select("key"), "key", "left_anti"))


def canonical(rows: DataFrame, key: Column, aliases: DataFrame, name: str = "key") -> DataFrame:
    """Rows with ``name``: the key, replaced by its canonical form where it is an alias (one hop)."""
    a = aliases.select(F.col("key").alias("_alias"), F.col("canonical").alias("_canonical"))
    x = rows.withColumn("_key", key).join(a, F.col("_key") == F.col("_alias"), "left")
    return x.withColumn(name, F.coalesce("_canonical", "_key")).drop("_key", "_alias", "_canonical")


def canonical_terms(terms: DataFrame, aliases: DataFrame, owner: str = "profile_id") -> DataFrame:
    """(owner, key, display, ord): the canonical keys of terms (owner, term, ord), the first of each."""
    x = terms.select(owner, T.clean_text(F.col("term")).alias("display"), "ord").filter("display is not null")
    x = canonical(x, T.skill_key(F.col("display")), aliases).filter("key <> ''")
    return first_by(x, [owner, "key"], ["ord"])


def canonical_names(terms: DataFrame, names: DataFrame) -> DataFrame:
    """Terms (..., term) that the ontology knows, with ``name``; ``names``: key, name."""
    keys = names.select("key", "name")
    return terms.withColumn("key", T.skill_key(F.col("term"))).join(keys, "key").drop("key")


def expand_held(terms: DataFrame, names: DataFrame, reach: DataFrame) -> DataFrame:
    """(profile_id, name, state): ``have`` for named skills, ``implied`` for what they reach.

    As skills come in order, one that an earlier skill implies stays implied.
    """
    own = canonical_names(terms, names).groupBy("profile_id", "name").agg(F.min("ord").alias("ord"))
    got = own.join(reach, own.name == reach.src).select("profile_id", F.col("dst").alias("name"), F.struct("ord", F.when(F.col("src") == F.col("dst"), 0).otherwise(1).alias("by")).alias("first"))
    best = got.groupBy("profile_id", "name").agg(F.min("first").alias("first"))
    return best.select("profile_id", "name", F.when(F.col("first.by") == 0, "have").otherwise("implied").alias("state"))


def prepare(explicit: DataFrame, context: DataFrame, aliases: DataFrame, names: DataFrame, edges: DataFrame) -> DataFrame:
    """(profile_id, key, display, source, confidence, via, ord) of every profile.

    ``explicit``, ``context``: profile_id, term, ord; ``names``: key, name of the ontology.
    """
    one = F.lit(1.0)
    none = F.lit(None).cast("string")
    parts = [
        canonical_terms(explicit, aliases).select("profile_id", "key", "display", F.lit(0).alias("tier"), "ord", one.alias("confidence"), none.alias("via")),
        canonical_terms(context, aliases).select("profile_id", "key", "display", F.lit(1).alias("tier"), "ord", one.alias("confidence"), none.alias("via")),
    ]
    held = canonical_names(explicit, names).select("profile_id", F.col("name").alias("skill")).distinct()
    implied = implied_with_hops(held, edges)
    implied = canonical(implied, T.skill_key(F.col("skill")), aliases)
    parts.append(implied.select("profile_id", "key", F.col("skill").alias("display"), F.lit(2).alias("tier"), F.col("hop").alias("ord"), "confidence", "via"))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    rows = first_by(rows, ["profile_id", "key"], ["tier", "ord", "display"])
    source = F.when(F.col("tier") == 0, "explicit").when(F.col("tier") == 1, "context").otherwise("ontology_implied")
    return rows.select("profile_id", "key", "display", source.alias("source"), "confidence", "via", "ord")
