"""Alignment of prepared skill profiles with role requirements.

The theta joins (variant, shared tokens, mention in context) are made once over the distinct
keys, blocked by a shared token, compact key or opening letters, and then joined to profiles and
roles by equality.  Their size follows the vocabulary, not profiles times roles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scoring import CONTEXT, DEFAULT_WEIGHT, FULL, REVERSE, TOKEN, importance, importance_rank, severity
from .candidates import SLOTS, slot
from .grid import CELL, grid, pair_keys
from .ontology import first_by
from .prepared import canonical

#: Letters of a requirement that a term must hold before it is looked at whole.
OPENING = 3
#: Requirements of a role, about: rows that a pair has.
LISTED = 10


def _keys(names: DataFrame, col: str) -> DataFrame:
    """Blocking keys of each name: its singular tokens, and its compact key without end digits."""
    k = T.skill_key(F.col(col))
    stem = F.concat(F.lit("="), F.regexp_replace(F.replace(k, F.lit(" "), F.lit("")), "[0-9]+$", ""))
    return names.select(col, F.explode(F.array_union(T.tokens(k), F.array(stem))).alias("block"))


def pair_scores(required: DataFrame, candidates: DataFrame) -> DataFrame:
    """(required, candidate, score): 1 for variants, 0.75 for shared tokens; other pairs are left out.

    Both inputs have one column of distinct names.  A variant pair shares its digit-less
    compact key and a token pair shares a token, so the blocks lose no pair.
    """
    r, c = required.toDF("required"), candidates.toDF("candidate")
    pairs = _keys(r, "required").join(_keys(c, "candidate"), "block").select("required", "candidate").distinct()
    a, b = T.skill_key(F.col("required")), T.skill_key(F.col("candidate"))
    score = F.when(T.variant_match(a, b), F.lit(FULL)).when(T.token_match(a, b), F.lit(TOKEN))
    return pairs.withColumn("score", score).filter("score is not null")


def best_candidates(required: DataFrame, held: DataFrame) -> DataFrame:
    """(profile_id, required, score, closest): a variant anywhere, else the first token match in list order; held: profile_id, key, ord."""
    scores = pair_scores(required, held.select("key").distinct())
    rows = held.join(scores, held.key == scores.candidate).select("profile_id", "required", "score", F.col("candidate").alias("closest"), "ord")
    return first_by(rows, ["profile_id", "required"], [F.desc("score"), "ord"]).drop("ord")


def mentions(required: DataFrame, terms: DataFrame) -> DataFrame:
    """(required, term): pairs of distinct keys where the term's compact form holds the requirement's.

    Blocked by the first letters of the requirement: a term that holds it holds these.
    """
    r = required.toDF("required").withColumn("rc", T.compact_key(F.col("required"))).filter("rc <> ''")
    r = r.withColumn("block", F.substring("rc", 1, OPENING))
    t = terms.toDF("term").withColumn("tc", T.compact_key(F.col("term")))
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(OPENING)), lambda n: F.transform(F.sequence(F.lit(1), F.length("tc")), lambda i: F.substring(F.col("tc"), i, n))))
    t = t.filter("tc <> ''").withColumn("block", F.explode(F.array_distinct(grams)))
    return t.join(r, "block").filter(F.contains(F.col("tc"), F.col("rc"))).select("required", "term").distinct()


def context_mentions(required: DataFrame, context: DataFrame) -> DataFrame:
    """(profile_id, required, closest): the first context key that matches or mentions the requirement; context: profile_id, key, ord."""
    keys = context.select("key").distinct()
    hits = mentions(required, keys).withColumnRenamed("term", "candidate").unionByName(pair_scores(required, keys).select("required", "candidate")).distinct()
    rows = context.join(hits, context.key == hits.candidate).select("profile_id", "required", F.col("candidate").alias("closest"), "ord")
    return first_by(rows, ["profile_id", "required"], ["ord"]).drop("ord")


def reverse_prerequisites(required: DataFrame, held: DataFrame, below: DataFrame) -> DataFrame:
    """(profile_id, required, closest): smallest held key that the requirement implies; below: required, key."""
    x = below.join(required.toDF("required"), "required", "left_semi").filter("required <> key")
    return held.join(x, "key").groupBy("profile_id", "required").agg(F.min("key").alias("closest"))


def prerequisites(reach: DataFrame, names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(required, key): canonical keys of what the ontology's name of a key reaches."""
    below = names.select(F.col("key").alias("required"), "name").join(reach, F.col("name") == F.col("src"))
    return canonical(below.select("required", "dst"), T.skill_key(F.col("dst")), aliases).select("required", "key").distinct()


def align(required: DataFrame, prepared: DataFrame, below: DataFrame) -> DataFrame:
    """(profile_id, required, score, source, closest) for every met requirement.

    ``required``: distinct canonical keys; ``prepared``: the rows of ``prepare``; ``below``: the
    rows of ``prerequisites``.  An explicit match wins; otherwise the best of implied, context
    and reverse, in that order on ties.  Requirements without any evidence have no row.
    """
    required = required.toDF("required")
    explicit = prepared.filter("source = 'explicit'").select("profile_id", "key", "ord")
    context = prepared.filter("source = 'context'").select("profile_id", "key", "ord")
    implied = prepared.filter("source = 'ontology_implied'")
    held = prepared.filter("source <> 'context'").select("profile_id", "key")
    tier = lambda df, score, n, source: df.select("profile_id", "required", score.cast("double").alias("score"), F.lit(n).alias("tier"), F.lit(source).alias("source"), "closest")
    parts = [
        tier(best_candidates(required, explicit), F.col("score"), 0, "explicit"),
        tier(implied.join(required, implied.key == F.col("required")).select("profile_id", "required", "confidence", F.coalesce("via", "display").alias("closest")), F.col("confidence"), 1, "ontology_implied"),
        tier(context_mentions(required, context), F.lit(CONTEXT), 2, "context"),
        tier(reverse_prerequisites(required, held, below), F.lit(REVERSE), 3, "reverse_partial"),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    explicit_first = F.when(F.col("tier") == 0, 0).otherwise(1)
    best = first_by(rows, ["profile_id", "required"], [explicit_first, F.desc("score"), "tier"]).drop("tier")
    shown = prepared.select("profile_id", F.col("key").alias("closest"), F.col("display").alias("_shown"))
    return best.join(shown, ["profile_id", "closest"], "left").withColumn("closest", F.coalesce("_shown", "closest")).drop("_shown")


def requirements(listed: DataFrame, aliases: DataFrame, hints: DataFrame) -> DataFrame:
    """(role_id, required, display, domain, tag, weight, ord) of listed skills (role_id, skill, domain, score, ord).

    Keys are canonical, the first of a role counts.  Where several names share a canonical key,
    score, domain and display come from the name that is canonical itself, else from the first.
    A role without any score weighs all alike; a skill without one in another role weighs half.
    The domain is the tag, else the ontology's first hint (``hints``: key, hint), else the display.
    """
    x = canonical(listed.withColumn("own", T.skill_key(F.col("skill"))).filter("own <> ''"), F.col("own"), aliases, "required")
    # maps by own key: the last score and domain, the first display
    w = Window.partitionBy("role_id", "own")
    x = x.withColumns({"score": F.max_by("score", F.when(F.col("score").isNotNull(), F.col("ord"))).over(w), "tag": F.max_by(F.trim("domain"), F.when(F.trim("domain") != "", F.col("ord"))).over(w), "shown": F.min_by(F.trim("skill"), "ord").over(w)})
    order = F.struct(F.when(F.col("own") == F.col("required"), 0).otherwise(1).alias("o"), "ord")
    g = x.groupBy("role_id", "required").agg(F.min("ord").alias("ord"), F.min_by("score", F.when(F.col("score").isNotNull(), order)).alias("score"), F.min_by("tag", F.when(F.col("tag").isNotNull(), order)).alias("tag"), F.min_by("shown", order).alias("display"))
    any_ = F.max("score").over(Window.partitionBy("role_id"))
    g = g.withColumn("weight", F.when(any_.isNull(), 1.0).otherwise(F.coalesce("score", F.lit(DEFAULT_WEIGHT))))
    h = hints.select(F.col("key").alias("required"), "hint")
    return g.join(h, "required", "left").select("role_id", "required", "display", F.coalesce("tag", "hint", "display").alias("domain"), F.coalesce("tag", F.lit("")).alias("tag"), "score", "weight", "ord")


def role_alignment(needed: DataFrame, profiles: DataFrame, aligned: DataFrame) -> DataFrame:
    """Every (profile, role, requirement) with its score, severity and importance; ``needed``: rows of ``requirements``.

    Every profile is set against every role, since each pair has a result of its own.  All rows of a
    pair are in one task, which their ``_cell`` tells to what groups by it.
    """
    listed = needed.groupBy("role_id").agg(F.collect_list(F.struct(*[c for c in needed.columns if c != "role_id"])).alias("needed"))
    met = aligned.groupBy("profile_id").agg(F.map_from_entries(F.collect_list(F.struct("required", F.struct("score", "source", "closest")))).alias("met"))
    people = profiles.select("profile_id").distinct().join(met, "profile_id", "left")
    rows = grid(people, listed, keep=LISTED).select("profile_id", "role_id", CELL, "met", F.explode("needed").alias("n")).select("profile_id", "role_id", CELL, "n.*", F.col("met")[F.col("n.required")].alias("m"))
    score = F.coalesce("m.score", F.lit(0.0))
    tier = importance(F.col("score"))
    rows = rows.withColumns({"importance": tier, "importance_rank": importance_rank(tier)}).drop("score")
    return rows.withColumns({"score": score, "source": F.coalesce("m.source", F.lit("")), "closest": F.col("m.closest"), "severity": severity(score)}).drop("m")


def alignment_sides(needed: DataFrame, profiles: DataFrame, aligned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(profile_id, evidence) of every profile and (role_id, needed) of every role that has any, as lists in a fixed order (``grid.kinds``)."""
    tier = importance(F.col("score"))
    one = F.struct("ord", "required", "display", "domain", "tag", "weight", tier.alias("importance"), importance_rank(tier).alias("importance_rank"))
    listed = needed.groupBy("role_id").agg(F.array_sort(F.collect_list(one)).alias("needed"))
    met = aligned.groupBy("profile_id").agg(F.array_sort(F.collect_list(F.struct("required", "score", "source", "closest"))).alias("evidence"))
    return profiles.select("profile_id").distinct().join(met, "profile_id", "left"), listed


def slotted(people: DataFrame) -> DataFrame:
    """People with ``met``: the evidence in ``SLOTS`` lists by a hash of the requirement, for ``looked_up``."""
    lists = F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.filter("evidence", lambda e: slot(e["required"]) == i))
    return people.withColumn("met", lists).drop("evidence")


def looked_up(pairs: DataFrame) -> DataFrame:
    """Pairs with ``needed`` and ``met`` (``slotted``) as pairs with ``x``: the rows of ``role_alignment`` as an array in order; empty without requirements."""

    def one(n: Column) -> Column:
        def told(m: Column) -> Column:
            score = F.coalesce(m["score"], F.lit(0.0))
            return F.struct(*[n[c].alias(c) for c in ("ord", "required", "display", "tag", "weight", "importance", "importance_rank")], score.alias("score"), F.coalesce(m["source"], F.lit("")).alias("source"), m["closest"].alias("closest"), severity(score).alias("severity"))

        return T.bind(F.get(F.filter(F.get("met", slot(n["required"])), lambda e: e["required"] == n["required"]), F.lit(0)), told)

    x = pairs.withColumn("x", F.transform("needed", one))
    return x.withColumn("x", F.coalesce("x", F.array().cast(x.schema["x"].dataType))).drop("needed", "met")


def shown(x: Column, kept: Callable[[Column], Column]) -> Column:
    """What the requirements of a pair (``looked_up``) that are ``kept`` are called, in order."""
    return F.transform(F.filter(x, kept), lambda n: n["display"])


def told(pairs: DataFrame) -> DataFrame:
    """Pairs of ``looked_up`` with the columns of ``reports`` but the maps by domain."""
    add = lambda f: F.aggregate("x", F.lit(0.0), lambda s, n: s + f(n))
    total = add(lambda n: n["weight"])
    gap = lambda g: F.struct(g["importance_rank"], g["score"].alias("transferability"), *[g[c].alias(c) for c in ("ord", "required", "display", "closest", "severity", "importance")], g["tag"].alias("domain"), g["source"].alias("source"))
    return pairs.withColumns(
        {
            "coverage": F.when(total > 0, add(lambda n: n["score"] * n["weight"]) / total).otherwise(0.0),
            "matched_skills": shown(F.col("x"), lambda n: n["score"] >= TOKEN),
            "missing_skills": shown(F.col("x"), lambda n: n["score"] == 0),
            "skill_gaps": F.array_sort(F.transform(F.filter("x", lambda n: n["score"] < FULL), gap)),
        }
    )


def coverage(rows: DataFrame) -> DataFrame:
    """Weighted skill coverage per profile and role; 0 where nothing weighs."""
    total = F.sum("weight")
    return rows.groupBy(*pair_keys(rows)).agg(F.when(total > 0, F.sum(F.col("score") * F.col("weight")) / total).otherwise(0.0).alias("coverage"), F.count_if(F.col("score") >= TOKEN).alias("matched"), F.count_if(F.col("score") == 0).alias("missing")).drop(CELL)


def _in_order(rows_when, value: str = "display"):
    return F.transform(F.array_sort(F.collect_list(F.when(rows_when, F.struct("ord", value)))), lambda s: s[value])


def domain_coverage(rows: DataFrame) -> DataFrame:
    """Mean score and skills, in order, per profile, role and domain."""
    return rows.groupBy(*pair_keys(rows), "domain").agg(F.round(F.avg("score"), 4).alias("coverage"), F.array_join(_in_order(F.lit(True)), ",").alias("skills"), F.min("ord").alias("ord"))


def reports(rows: DataFrame) -> DataFrame:
    """One row per profile and role: coverage, status lists, gaps in order, and domain maps."""
    gap = F.when(F.col("score") < FULL, F.struct("importance_rank", F.col("score").alias("transferability"), "ord", "required", "display", "closest", "severity", "importance", F.col("tag").alias("domain"), "source"))
    keys = pair_keys(rows)
    value = F.struct("o", "domain", "coverage", "skills")
    # by domain first, so that a pair is read once; its domains come in the order of their first skills
    parts = rows.groupBy(*keys, "domain").agg(
        F.round(F.avg("score"), 4).alias("coverage"), _in_order(F.lit(True)).alias("skills"), F.min("ord").alias("o"),
        F.collect_list(F.struct("ord", "display", "score", "weight")).alias("_all"), F.collect_list(gap).alias("_gaps"),
    )
    per = parts.groupBy(*keys).agg(
        F.array_sort(F.flatten(F.collect_list("_all"))).alias("_all"), F.array_sort(F.flatten(F.collect_list("_gaps"))).alias("skill_gaps"), F.array_sort(F.collect_list(value)).alias("_domains")
    )
    shown = lambda kept: F.transform(F.filter("_all", kept), lambda x: x["display"])
    add = lambda f: F.aggregate("_all", F.lit(0.0), lambda s, x: s + f(x))
    total = add(lambda x: x["weight"])
    entries = lambda c: F.map_from_entries(F.transform("_domains", lambda x: F.struct(x["domain"], x[c])))
    return per.select(
        "profile_id",
        "role_id",
        F.when(total > 0, add(lambda x: x["score"] * x["weight"]) / total).otherwise(0.0).alias("coverage"),
        shown(lambda x: x["score"] >= TOKEN).alias("matched_skills"),
        shown(lambda x: x["score"] == 0).alias("missing_skills"),
        "skill_gaps",
        entries("coverage").alias("domain_coverage"),
        entries("skills").alias("domain_skills"),
    )
