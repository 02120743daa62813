"""Text keys as Column functions: everything stays in the JVM.

Null and blank count as missing: the key functions give '' and the cleaning functions null
where their docstring says so.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as Python's str.split sees it.
SPACE = r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACES = f"[{SPACE}]+"
#: Runs that are not a single plain space already: replacing them by one gives what replacing all runs gives.
OTHER_SPACES = f" ?[{SPACE}&&[^ ]][{SPACE}]*| [{SPACE}]+"
OTHER_THAN_KEY = " ?[^a-z0-9+# ][^a-z0-9+#]*| [^a-z0-9+#]+"


def bind(x: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is read."""
    return F.element_at(F.transform(F.array(x), use), 1)


def folded(x: Column) -> Column:
    """Lower case, with the one frequent letter whose full case folding differs."""
    return F.lower(F.replace(x, F.lit("ß"), F.lit("ss")))


def skill_key(x: Column) -> Column:
    """Key of a skill: folded, runs of other than a-z 0-9 + # are one space; null gives ''."""
    return F.trim(F.regexp_replace(folded(F.coalesce(x, F.lit(""))), OTHER_THAN_KEY, " "))


def compact_key(x: Column) -> Column:
    """Skill key without separators."""
    return F.regexp_replace(folded(F.coalesce(x, F.lit(""))), "[^a-z0-9+#]+", "")


def certification_key(x: Column) -> Column:
    """Key of a certification: letters and digits only."""
    return F.trim(F.regexp_replace(folded(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", " "))


def clean_text(x: Column) -> Column:
    """White space runs collapsed and trimmed; blank gives null."""
    return F.nullif(F.trim(F.regexp_replace(x, OTHER_SPACES, " ")), F.lit(""))


def truncate_words(x: Column, n: int) -> Column:
    """Cleaned text, cut to ``n`` characters at a word's end and marked `` ...`` if longer."""
    return bind(clean_text(x), lambda c: cut_words(c, n))


def cut_words(c: Column, n: int) -> Column:
    """``truncate_words`` of a cleaned text."""
    at_word = F.regexp_replace(F.substring(c, 1, n), r" [^ ]*$", "")
    return F.when(F.length(c) > n, F.concat(at_word, F.lit(" ..."))).otherwise(c)


def keys_of(key: Column) -> Column:
    """(skill, compact, cert) of a skill key: ``compact_key`` and ``certification_key`` of the text it is of."""
    cert = F.when(F.contains(key, F.lit("+")) | F.contains(key, F.lit("#")), certification_key(key)).otherwise(key)
    return F.struct(key.alias("skill"), F.replace(key, F.lit(" "), F.lit("")).alias("compact"), cert.alias("cert"))


def card_summary(x: Column, most: int = 180) -> Column:
    """First two sentences; over ``most`` characters cut at a word and marked ``...``."""
    c = clean_text(x)
    two = F.regexp_extract(F.concat(c, F.lit(" ")), r"^((?:.*?[.!?] ){1,2})", 1)
    s = F.trim(F.when(two != "", two).otherwise(c))
    cut = F.regexp_replace(F.substring(s, 1, most - 3), r" [^ ]*$", "")
    return F.when(F.length(s) > most, F.concat(F.regexp_replace(cut, r"[ ,;:\-]+$", ""), F.lit("..."))).otherwise(s)


def ordered_distinct(values: Column, key=lambda v: F.lower(F.trim(v))) -> Column:
    """First spelling of each key, in order; blanks and nulls dropped."""
    kept = F.filter(values, lambda v: F.coalesce(F.trim(v), F.lit("")) != "")
    # each key with its first place: a value stays where it is the first of its key
    pair = lambda k: F.filter(k["v"], lambda v, i: F.array_position(k["k"], key(v)) == i + 1)
    return bind(F.struct(kept.alias("v"), F.transform(kept, key).alias("k")), pair)


def clean_distinct(values: Column) -> Column:
    """Cleaned values, the first spelling of each, in order."""
    return ordered_distinct(F.transform(F.coalesce(values, F.array().cast("array<string>")), clean_text), folded)


def trimmed_distinct(values: Column, most: int = 50) -> Column:
    """Trimmed values, the first spelling of each, ``most`` at most."""
    return F.slice(F.transform(ordered_distinct(F.coalesce(values, F.array().cast("array<string>"))), lambda v: F.trim(v)), 1, most)


def joined_distinct(values: Column, most: int | None = None) -> Column:
    """Clean distinct values as one text, or null."""
    v = clean_distinct(values)
    text = F.array_join(F.slice(v, 1, most) if most else v, ", ")
    return F.nullif(text, F.lit(""))


def first_text(*values: Column) -> Column:
    """First value that is not blank, cleaned."""
    return F.coalesce(*[clean_text(v) for v in values])


def split_list(x: Column, pattern: str = r"[;,|\n•]+") -> Column:
    """Delimited text to trimmed, ordered, case-insensitively distinct parts."""
    return ordered_distinct(F.transform(F.split(F.coalesce(x, F.lit("")), pattern), lambda v: F.trim(v)))


def listify(x: Column) -> Column:
    """JSON array text or delimited text (also by '/') to ordered distinct parts."""
    from_json = F.when(x.startswith("["), F.from_json(x, "array<string>"))
    return ordered_distinct(F.transform(F.coalesce(from_json, F.split(F.coalesce(x, F.lit("")), r"[,;|/]+")), lambda v: F.trim(v)))


def singular(token: Column) -> Column:
    """Without a trailing s, if longer than three letters."""
    return F.when((F.length(token) > 3) & token.endswith("s"), F.substring(token, F.lit(1), F.length(token) - 1)).otherwise(token)


def tokens(key: Column) -> Column:
    """Distinct singular tokens of a skill key."""
    return F.array_distinct(F.transform(F.filter(F.split(key, " "), lambda t: t != ""), singular))


def variant_match(required: Column, candidate: Column) -> Column:
    """Equal keys, equal compact keys, or one compact key is the other with digits behind it."""
    a, b = F.replace(required, F.lit(" "), F.lit("")), F.replace(candidate, F.lit(" "), F.lit(""))
    longer = lambda x, y: x.startswith(y) & F.substring(x, F.length(y) + 1, F.length(x)).rlike("^[0-9]+$")
    return (a != "") & (b != "") & ((required == candidate) | (a == b) | longer(a, b) | longer(b, a))


def token_match(required: Column, candidate: Column) -> Column:
    """A token set holds the other, or half of the required tokens are shared."""
    r, c = tokens(required), tokens(candidate)
    both = F.size(F.array_intersect(r, c))
    return (F.size(r) > 0) & (F.size(c) > 0) & ((both == F.size(r)) | (both == F.size(c)) | (both * 2 >= F.size(r)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


#: Levels from the lowest, and their other names in order of search.
LEVELS = ("intern", "junior", "mid", "senior", "lead", "staff", "principal", "director")
LEVEL_ALIASES = (
    ("entry", "junior"), ("entry level", "junior"), ("associate", "junior"), ("apprentice", "junior"), ("beginner", "junior"),
    ("graduate", "junior"), ("jr", "junior"), ("student", "junior"), ("trainee", "junior"), ("intermediate", "mid"), ("regular", "mid"),
    ("sr", "senior"), ("snr", "senior"), ("architect", "lead"), ("team lead", "lead"), ("tech lead", "lead"),
    ("head", "director"), ("vp", "director"), ("chief", "director"),
)


def seniority_level(title: Column) -> Column:
    """Level named in a title as a whole word, highest level first, then the other names; else null."""
    tests = [(x, x) for x in reversed(LEVELS)] + list(LEVEL_ALIASES)
    return bind(F.concat(F.lit(" "), skill_key(title), F.lit(" ")), lambda t: F.coalesce(*[F.when(F.contains(t, F.lit(f" {word} ")), F.lit(level)) for word, level in tests]))


def level_of_label(label: Column) -> Column:
    """Level of a structured label (a level or one of its other names); else null."""
    k = folded(F.trim(label))
    known = F.create_map(*[F.lit(v) for x in (*((x, x) for x in LEVELS), *LEVEL_ALIASES) for v in x])
    return known[k]


def seniority_gap(user: Column, role: Column) -> tuple[Column, Column]:
    """Label and fit of a user's level against a role's."""
    rank = F.create_map(*[F.lit(v) for i, x in enumerate(LEVELS) for v in (x, i)])
    d = rank[role] - rank[user]
    label = F.when(d.isNull(), "unknown").when(d == 0, "match").when(d > 0, "stretch").otherwise("overqualified")
    fit = F.when(d.isNull(), 0.70).when(d == 0, 1.0).when(d > 0, F.greatest(F.lit(0.25), 0.65 - 0.20 * (d - 1))).otherwise(F.greatest(F.lit(0.75), 0.90 - 0.05 * (F.abs(d) - 1)))
    return label, fit


#: Keywords of each career domain, in order of output.
DOMAIN_WORDS = {
    "architecture": ("architect", "architecture", "system design", "distributed systems"),
    "backend": ("backend", "api", "rest", "service", "server", "microservice"),
    "cloud": ("cloud", "aws", "azure", "gcp", "infrastructure"),
    "frontend": ("frontend", "front end", "react", "vue", "angular", "web ui"),
    "fullstack": ("fullstack", "full stack"),
    "software_engineering": ("software engineering", "software engineer", "software developer", "software development", "tooling engineer", "developer tooling"),
    "ai_ml": ("artificial intelligence", "machine learning", "deep learning", "ai", "ml"),
    "automation_scripting": ("automation", "scripting", "process automation", "workflow"),
    "data_engineering": ("big data", "data scale", "data engineering", "data pipeline", "etl", "spark"),
    "data_analytics": ("analytics", "business intelligence", "dashboard", "reporting", "sql analysis"),
    "devops": ("devops", "ci cd", "continuous integration", "jenkins", "ansible", "build automation", "release cadence", "kubernetes", "docker", "terraform", "platform engineering"),
    "qa_testing": ("qa", "quality assurance", "testing", "test automation", "automated testing", "selenium", "junit", "quality gates"),
    "cybersecurity": ("security", "cybersecurity", "appsec", "iam", "threat"),
    "database": ("database", "postgres", "postgresql", "mysql", "sql", "nosql"),
    "ux_ui": ("ux", "ui", "user experience", "user interface", "design system"),
    "support": ("support", "customer success", "helpdesk", "service desk"),
    "project_management": ("project management", "program management", "scrum", "agile", "stakeholder"),
}


def keyword_domains(text: Column, words: dict[str, tuple[str, ...]] = DOMAIN_WORDS) -> Column:
    """Domains with a keyword in the text as whole words, in the table's order."""

    def named(t: Column) -> Column:
        hits = []
        for name, keys in words.items():
            any_ = F.lit(False)
            for k in keys:
                any_ = any_ | F.contains(t, F.lit(f" {k} "))
            hits.append(F.when(any_, F.lit(name)))
        return F.array_compact(F.array(*hits))

    return bind(F.concat(F.lit(" "), skill_key(text), F.lit(" ")), named)


#: Words that say nothing about a domain.
DOMAIN_STOPS = ("and", "the", "with", "for", "role", "engineer", "developer", "specialist", "analyst", "senior", "junior", "mid", "level", "builds", "building", "systems", "using")


def domain_terms(terms: Column) -> Column:
    """Words of more than three letters that are no stop words, and their adjacent pairs, of an array of texts."""

    def one(term: Column) -> Column:
        key = skill_key(F.replace(F.coalesce(term, F.lit("")), F.lit("_"), F.lit(" ")))
        words = F.filter(F.split(key, " "), lambda w: (F.length(w) > 3) & ~w.isin(*DOMAIN_STOPS))
        pairs = lambda w: F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", F.get(w, i), x))
        return bind(words, lambda w: F.concat(w, pairs(w)))

    return F.array_distinct(F.flatten(F.transform(terms, one)))


#: Words that mark personal data in what is said about a free-text item.
PII_TERMS = ("address", "birth", "contact", "date of birth", "email", "gender", "nationality", "phone", "website")


def is_pii(label: Column, section: Column, reason: Column, value: Column) -> Column:
    """A marking word in label, section or reason, or an address in the value."""
    low = F.lower(F.concat_ws(" ", label, section, reason))
    v = F.lower(F.coalesce(value, F.lit("")))
    return low.rlike("|".join(PII_TERMS)) | v.rlike("https?://|@")


#: Certifications that count as one another.
CERTIFICATION_GROUPS = (
    ("Google Data Analytics Certificate", "Google Data Analytics Professional Certificate"),
    ("Oracle Certified Associate Java Programmer", "Oracle Certified Associate (OCA) - Java", "Oracle Java Programmer Certification", "OCA Java"),
    ("CompTIA A+", "CompTIA A Plus", "CompTIA A+ Certification"),
)


def certification_group(name: Column, groups: tuple[tuple[str, ...], ...] = CERTIFICATION_GROUPS) -> Column:
    """One key for all names of a group of certifications, else the own key; '' if blank."""

    def grouped(key: Column) -> Column:
        out = None
        for n, names in enumerate(groups):
            same = F.exists(F.array(*[certification_key(F.lit(x)) for x in names]), lambda k: k == key)
            out = (F.when if out is None else out.when)(same, F.lit(f"group {n}"))
        return out.otherwise(key)

    return bind(certification_key(name), grouped)


#: Degree abbreviations and what they stand for, in order.
DEGREES = (
    (r"\bm\s*\.?\s*sc\b", "master science"),
    (r"\bb\s*\.?\s*sc\b", "bachelor science"),
    (r"\bm\s*\.?\s*eng\b", "master engineering"),
    (r"\bb\s*\.?\s*eng\b", "bachelor engineering"),
    (r"\bm\s*\.?\s*a\b", "master arts"),
    (r"\bb\s*\.?\s*a\b", "bachelor arts"),
    (r"\bmsc\b", "master science"),
    (r"\bbsc\b", "bachelor science"),
)
#: Words left out in the second comparison of two texts.
LIGHT_STOPS = ("a", "an", "and", "for", "in", "of", "the", "with")


def plain_text(x: Column) -> Column:
    """Folded text with degrees spelled out, without punctuation; null gives ''."""
    t = folded(F.coalesce(x, F.lit("")))
    for pattern, words in DEGREES:
        t = F.regexp_replace(t, pattern, words)
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"(?U)[^\w\s]+", " "), r"(?U)\s+", " "))


def texts_match(a: Column, b: Column) -> Column:
    """Whether two plain texts are equal, or one of four letters or more holds the other, with or without light words."""
    direct = lambda x, y: (x == y) | ((F.length(x) >= 4) & (F.contains(y, x) | F.contains(x, y)))
    light = lambda x: F.array_join(F.filter(F.split(x, " "), lambda w: (w != "") & ~w.isin(*LIGHT_STOPS)), " ")
    return direct(a, b) | direct(light(a), light(b))


def date_range(start: Column, end: Column) -> Column:
    """The years of a period, then ``present`` if it goes on, each once."""
    text = F.concat_ws(" ", F.nullif(F.trim(start), F.lit("")), F.nullif(F.trim(end), F.lit("")))
    years = F.regexp_extract_all(text, F.lit(r"\b((?:19|20)[0-9]{2})\b"), 1)
    now = F.when(F.lower(text).rlike(r"\b(present|current|now|ongoing)\b"), F.array(F.lit("present"))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.array_distinct(F.concat(years, now)), " ")


def safe_name(x: Column) -> Column:
    """A file name: runs of other than letters, digits, ``_ . -`` are one ``_``, none at the ends."""
    return F.regexp_replace(F.regexp_replace(x, r"[^A-Za-z0-9_.-]+", "_"), r"^_+|_+$", "")


def json_or_text(x: Column) -> Column:
    """The value as JSON text: as it is if it is JSON, else as a JSON string."""
    quoted = F.regexp_extract(F.to_json(F.array(x)), r"^\[(.*)\]$", 1)
    return F.when(F.try_parse_json(x).isNotNull(), x).otherwise(quoted)


def shown_text(x: Column) -> Column:
    """Trimmed text, null for placeholders: blank, ``Present`` or nothing but marks."""
    t = F.trim(x)
    return F.when((t != "") & (t != "Present") & t.rlike("[A-Za-z0-9]"), t)


def shown_distinct(values: Column) -> Column:
    """Shown texts, the first spelling of each, in order."""
    return ordered_distinct(F.transform(F.coalesce(values, F.array().cast("array<string>")), shown_text))


def shown_year(x: Column) -> Column:
    """First run of four digits of a shown text, else the text."""
    t = shown_text(x)
    y = F.regexp_extract(t, r"([0-9]{4})", 1)
    return F.when(y != "", y).otherwise(t)


def milestone_kind(target: Column, certifications: Column) -> Column:
    """Kind of a roadmap step by the words of its target."""
    k = folded(F.coalesce(target, F.lit("")))
    known = F.exists(certifications, lambda c: folded(c) == k)
    has = lambda *words: k.rlike("|".join(words))
    return F.when(known | has("certif", "exam"), "certification").when(has("portfolio", "project", "proof"), "project").when(has("role"), "role").when(has("experience", "transition"), "experience").otherwise("skill")


def percent_text(x: Column) -> Column:
    """One decimal and a percent sign; null is a dash."""
    return F.when(x.isNotNull(), F.format_string("%.1f%%", x * 100)).otherwise("-")


def year_of(x: Column) -> Column:
    """First run of four digits, else the cleaned text."""
    y = F.regexp_extract(x, r"([0-9]{4})", 1)
    return F.when(y != "", y).otherwise(clean_text(x))


def duration_weeks(x: Column) -> Column:
    """``n week(s)`` or ``n month(s)`` as weeks (a month has four), else null."""
    n = F.regexp_extract(F.lower(F.trim(x)), r"^([0-9]+) *(week|month)s?$", 1)
    unit = F.regexp_extract(F.lower(F.trim(x)), r"^([0-9]+) *(week|month)s?$", 2)
    return F.when(n != "", n.cast("int") * F.when(unit == "month", 4).otherwise(1))


def duration_text(weeks: Column) -> Column:
    """Up to four weeks in weeks, beyond in months rounded up."""
    months = F.ceil(weeks / 4).cast("int")
    w = F.concat(weeks.cast("string"), F.when(weeks == 1, " week").otherwise(" weeks"))
    m = F.concat(months.cast("string"), F.when(months == 1, " month").otherwise(" months"))
    return F.when(weeks <= 4, w).otherwise(m)


def timeline_text(x: Column, fallback: Column) -> Column:
    """A duration in its usual form, else ``fallback``."""
    return F.coalesce(duration_text(duration_weeks(x)), fallback)
