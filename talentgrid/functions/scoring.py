"""Scores, tiers and labels as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the six signals under each readiness bucket.
SIGNALS = ("capability", "intent", "identity", "skill", "domain", "seniority")
WEIGHTS = {
    "ready_now": (0.30, 0.10, 0.40, 0.23, 0.09, 0.08),
    "next_step": (0.13, 0.25, 0.28, 0.13, 0.14, 0.07),
    "aspirational": (0.10, 0.40, 0.20, 0.10, 0.15, 0.05),
}
#: Weights of the score that ranks, diversifies and is shown, whatever the bucket.
FINAL_WEIGHTS = (0.20, 0.10, 0.30, 0.23, 0.10, 0.07)
#: Shown score bands.
BANDS = {"ready_now": (85, 98), "next_step": (70, 84), "aspirational": (50, 69)}
#: Credits of the ways to meet a requirement.
FULL, TOKEN, CONTEXT, REVERSE, DEFAULT_WEIGHT = 1.0, 0.75, 0.6, 0.40, 0.5


def clamp01(x: Column) -> Column:
    """Between 0 and 1; null is 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x, F.lit(0.0))))


def rounded(x: Column, digits: int) -> Column:
    """Rounded as the SQL does it: the scaled double, halves away from zero.

    ``F.round`` rounds the shortest decimal text of a double, so a product that prints just beside a
    tie (0.48874999999999996) goes another way there than here, where it is scaled first.
    """
    scale = F.lit(float(10**digits))
    return F.signum(x) * F.floor(F.abs(x) * scale + F.lit(0.5)) / scale


def gated_domain(domain: Column, skill: Column) -> Column:
    """Domain overlap counts in full only with enough skill coverage."""
    return F.when(skill >= 0.35, domain).when(skill >= 0.20, F.least(domain, F.lit(0.50))).otherwise(F.least(domain, F.lit(0.25)))


def weighted(signals: dict[str, Column], bucket: str | None) -> Column:
    """Weighted sum of clamped signals, in the fixed order of signals; no bucket: the final score."""
    total = F.lit(0.0)
    for name, w in zip(SIGNALS, WEIGHTS[bucket] if bucket else FINAL_WEIGHTS, strict=True):
        total = total + clamp01(signals[name]) * F.lit(w)
    return total


def best_bucket(scores: dict[str, Column]) -> tuple[Column, Column]:
    """Name and value of the best score; ties go to the first bucket in order."""
    r, n, a = (scores[b] for b in WEIGHTS)
    name = F.when((r >= n) & (r >= a), "ready_now").when(n >= a, "next_step").otherwise("aspirational")
    return name, F.greatest(r, n, a)


def shown_score(score: Column, bucket: Column, low: Column, high: Column) -> Column:
    """Score stretched over its bucket's band; half goes to even."""
    t = F.when(high - low < 1e-9, clamp01(score)).otherwise((score - low) / (high - low))
    out = None
    for b, (lo, hi) in BANDS.items():
        out = (F.when if out is None else out.when)(bucket == b, F.bround(lo + t * (hi - lo)).cast("int"))
    return out


def hop_confidence(hop: Column) -> Column:
    """Credit of an implied skill by its distance."""
    return F.greatest(F.lit(0.35), F.round(F.lit(0.65) * F.pow(F.lit(0.8), hop - 1), 4))


def severity(score: Column) -> Column:
    return F.when(score >= 1, "matched").when(score >= 0.75, "low").when(score > 0, "medium").otherwise("high")


def coarse_severity(score: Column) -> Column:
    """The scale of raw coverage: half a credit is low already."""
    return F.when(score >= 1, "matched").when(score >= 0.5, "low").when(score > 0, "medium").otherwise("high")


def importance(weight: Column) -> Column:
    return F.when(weight.isNull(), "").when(weight >= 0.75, "essential").when(weight >= 0.40, "important").otherwise("nice_to_have")


def importance_rank(tier: Column) -> Column:
    return F.when(tier == "essential", 0).when(tier == "important", 1).when(tier == "nice_to_have", 2).otherwise(3)


def status(coverage: Column) -> Column:
    return F.when(coverage >= 0.70, "strong").when(coverage >= 0.35, "partial").otherwise("weak")


def readiness(skills: Column, certifications: Column, seniority: Column) -> Column:
    return F.lit(0.70) * skills + F.lit(0.20) * certifications + F.lit(0.10) * seniority


def readiness_tier(x: Column) -> tuple[Column, Column]:
    """Tier and timeline of an overall readiness."""
    tier = F.when(x >= 0.70, "ready_now").when(x >= 0.35, "next_step").otherwise("aspirational")
    return tier, F.when(x >= 0.70, "1-3 months").when(x >= 0.35, "3-5 months").otherwise("5-8 months")


#: Parts of a gap's priority.
IMPORTANCE_SCORE = {"essential": 1.0, "important": 0.65, "nice_to_have": 0.3}
EVIDENCE_GAP = {"": 1.0, "shared_alignment": 1.0, "context": 0.6, "ontology_implied": 0.45, "reverse_partial": 0.5}


def lookup(x: Column, values: dict[str, float], default: float) -> Column:
    out = None
    for k, v in values.items():
        out = (F.when if out is None else out.when)(x == k, F.lit(v))
    return out.otherwise(F.lit(default))


def lookup_text(x: Column, values: dict[str, str]) -> Column:
    """The text of a fixed table; null for other keys."""
    return F.coalesce(*[F.when(x == k, F.lit(v)) for k, v in values.items()])


def gap_priority(tier: Column, score: Column, domain_coverage: Column, source: Column, proof: Column, specificity: Column) -> Column:
    """Clamped weighted sum of importance, missingness, deficit, evidence, proof and specificity."""
    raw = (
        F.lit(0.35) * lookup(tier, IMPORTANCE_SCORE, 0.5)
        + F.lit(0.25) * (F.lit(1.0) - score)
        + F.lit(0.10) * (F.lit(1.0) - domain_coverage)
        + F.lit(0.10) * lookup(source, EVIDENCE_GAP, 0.75)
        + F.lit(0.05) * proof
        + F.lit(0.15) * specificity
        - F.lit(0.16) * (F.lit(1.0) - specificity)
    )
    return clamp01(raw)


def priority_label(p: Column) -> Column:
    return F.when(p >= 0.82, "critical").when(p >= 0.68, "high").when(p >= 0.45, "medium").otherwise("low")


def effort_label(transfer: Column) -> Column:
    return F.when(transfer >= 0.75, "quick_win").when(transfer > 0, "moderate").otherwise("substantial")


def signal_status(transfer: Column, source: Column) -> Column:
    return F.when(transfer <= 0, "missing").when(source == "context", "weakly_evidenced").otherwise("partial")


#: How well a gap of each domain can be proven.
PROOF_SIGNAL = {
    "softskills": 0.65, "soft skills": 0.65, "security": 0.95, "networking": 0.95, "software engineering": 0.9, "cloud": 0.95, "devops": 0.95,
    "databases": 0.9, "backend": 0.9, "frontend": 0.9, "data engineering": 0.9, "ai": 0.85,
}
#: Broad traits, phrases that mark one, soft domains, and marks of a concrete skill.
GENERIC_SKILLS = ("adaptability", "analytical skills", "attention to detail", "collaboration", "communication", "critical thinking", "leadership", "problem solving", "teamwork", "time management")
GENERIC_PHRASES = ("communication", "collaboration", "leadership", "problem solving", "teamwork")
SOFT_DOMAINS = ("softskills", "soft skills", "interpersonal skills")
TECHNICAL_MARKS = ("api", "aws", "azure", "ci cd", "css", "dns", "docker", "ethereum", "gcp", "git", "html", "javascript", "kubernetes", "linux", "node", "python", "react", "rest", "sql", "terraform", "typescript", "web3")


def specificity(key: Column, domain_key: Column) -> Column:
    """How concrete a skill (by its key) is; a technical mark counts anywhere in the key."""
    return (
        F.when(key.rlike("|".join(TECHNICAL_MARKS)), 0.95)
        .when(key.isin(*GENERIC_SKILLS), 0.20)
        .when(domain_key.isin(*SOFT_DOMAINS), 0.35)
        .when(key.rlike("|".join(GENERIC_PHRASES)), 0.45)
        .when(F.contains(key, F.lit(" ")), 0.85)
        .otherwise(0.70)
    )

def salary_text(monthly: Column) -> Column:
    """Yearly thousands, or '' if unknown."""
    return F.coalesce(F.concat(F.lit("EUR "), F.bround(monthly * 12 / 1000).cast("long").cast("string"), F.lit("k")), F.lit(""))


def dot(a: Column, b: Column) -> Column:
    """Sum of products, in the arrays' order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if a vector is zero."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n)
