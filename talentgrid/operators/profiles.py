"""Profile documents: privacy, matching profiles, embedding texts, validity, evidence, staged preparation.

All work on nested columns of one row per profile; nothing is exploded or shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..scratch import cut

STRINGS = "array<string>"


def _strings(x: Column) -> Column:
    return F.coalesce(x, F.array().cast(STRINGS))


def _null() -> Column:
    return F.lit(None).cast("string")


def unwrapped(docs: DataFrame, envelope: str = "confirmed_cv_data") -> DataFrame:
    """Documents as they are, or out of their envelope."""
    if envelope not in docs.columns:
        return docs
    return docs.select(*[c for c in docs.columns if c != envelope], f"{envelope}.*")


def confirmed(cvs: DataFrame, identity: Column, key: str = "profile_id") -> DataFrame:
    """(key, confirmed_cv_data, metadata, career_identity_statement): documents in their envelope; ``identity``: struct of label and summary."""
    body = F.struct(*[c for c in cvs.columns if c != key])
    empty = F.array().cast(STRINGS)
    meta = F.struct(F.current_timestamp().cast("timestamp_ntz").alias("confirmed_at"), empty.alias("confirmed_sections"), empty.alias("skipped_sections"), empty.alias("edited_sections"))
    return cvs.select(key, body.alias("confirmed_cv_data"), meta.alias("metadata"), F.concat(identity["label"], F.lit(": "), identity["summary"]).alias("career_identity_statement"))


def privacy_stripped(cvs: DataFrame) -> DataFrame:
    """The same documents and schema without names, contacts, links, places, organisations, institutions, grades and credentials.

    Free texts stay as they are; free items that speak of personal data are dropped.  Of a
    thesis (where documents have such a section) title, degree, description and technologies stay.
    """
    null = _null()

    def cleared(items: str, *names: str) -> Column:
        def one(x: Column) -> Column:
            for n in names:
                x = x.withField(n, null)
            return x

        return F.transform(items, one)

    kept = ("title", "degree_type", "description", "technologies")
    thesis = {"thesis": cleared("thesis", *[n for n in cvs.schema["thesis"].dataType.elementType.names if n not in kept])} if "thesis" in cvs.columns else {}
    if "thesis_title" in cvs.schema["education"].dataType.elementType.names:
        cvs = cvs.withColumn("education", cleared("education", "thesis_title"))
    return cvs.withColumns(
        {
            **thesis,
            "personal_info": F.col("personal_info").withField("full_name", null).withField("email", null).withField("phone", null),
            "experience": cleared("experience", "organization", "location", "start_date", "end_date"),
            "education": cleared("education", "institution", "grade"),
            "projects": F.transform("projects", lambda p: p.withField("organization", null).withField("role", null).withField("links", F.array().cast(STRINGS))),
            "certifications": cleared("certifications", "issuing_organization", "credential_id"),
            "unmapped_information": F.filter("unmapped_information", lambda u: ~T.is_pii(u["label"], u["source_section"], u["reason_not_mapped"], u["value"])),
        }
    )


def skill_keywords(skills: Column) -> Column:
    """Names of technical, then soft skills, trimmed, the first spelling of each."""
    names = F.concat(F.transform(skills["technical_skills"], lambda s: s["name"]), F.transform(skills["soft_skills"], lambda s: s["name"]))
    return F.transform(T.ordered_distinct(names, lambda v: T.folded(F.trim(v))), lambda v: F.trim(v))


def fallback_identity(cvs: DataFrame) -> Column:
    """Struct of label and summary from what a document says, without a model."""
    jobs = F.filter(F.transform("experience", lambda e: e["role"]), lambda r: F.coalesce(r, F.lit("")) != "")
    label = F.coalesce(F.nullif(F.col("personal_info.current_role"), F.lit("")), F.get(jobs, F.lit(0)), F.lit("Career Explorer"))
    interests = F.filter(_strings(F.col("interests")), lambda i: F.trim(i) != "")
    signals = F.concat(F.slice(skill_keywords(F.col("skills_extracted")), 1, 4), F.slice(interests, 1, 3))
    made = F.when(F.size(signals) > 0, F.concat(F.lit("Profile combines career signals across "), F.array_join(signals, ", "), F.lit("."))).otherwise("Profile contains enough career signal to begin role matching.")
    return F.struct(label.alias("label"), F.coalesce(F.nullif(F.col("profile_summary.summary"), F.lit("")), made).alias("summary"))


def pruned(items: Column, *names: str) -> Column:
    """Items with the named fields only, blanks as null (zero stays); items without any are dropped."""
    value = lambda x, n: F.nullif(x[n], F.lit("")) if n not in LISTS else F.when(F.size(x[n]) > 0, x[n])
    small = F.transform(items, lambda x: F.struct(*[(x[n] if n in NUMBERS else value(x, n)).alias(n) for n in names]))
    def any_(x: Column) -> Column:
        out = x[names[0]].isNotNull()
        for n in names[1:]:
            out = out | x[n].isNotNull()
        return out

    return F.filter(small, any_)


LISTS = ("courses", "core_responsibilities", "contextual_skills", "technologies", "outcomes")
NUMBERS = ("duration_months",)


def embedding_profile(stripped: DataFrame, identity: Column, key: str = "profile_id") -> DataFrame:
    """The sections that are embedded, without blanks; ``to_json`` of a section leaves its nulls out."""
    return stripped.select(
        key,
        identity.alias("career_identity_summary"),
        pruned(F.col("education"), "entry_type", "degree_type", "field_of_study", "start_date", "end_date", "courses").alias("education"),
        pruned(F.col("experience"), "role", "industry", "start_date", "end_date", "duration_months", "core_responsibilities", "contextual_skills").alias("experience"),
        skill_keywords(F.col("skills_extracted")).alias("skills"),
        F.array_distinct(F.filter(F.transform(_strings(F.col("interests")), lambda v: F.trim(v)), lambda i: i != "")).alias("interests"),
        pruned(F.col("certifications"), "name", "issue_date", "expiration_date").alias("certifications"),
        pruned(F.col("projects"), "title", "description", "technologies", "outcomes", "start_date", "end_date").alias("projects"),
        F.coalesce("potential_direction", F.lit("")).alias("potential_direction"),
    )


def career_profile(cvs: DataFrame, identity: Column, key: str = "profile_id") -> DataFrame:
    """The matching profile of a document."""
    skills = F.col("skills_extracted")
    names = F.concat(*[F.transform(skills[s], lambda x: x["name"]) for s in ("technical_skills", "inferred_skills", "soft_skills")])
    blank = F.lit("")
    joined = lambda values, sep: F.nullif(F.array_join(T.shown_distinct(values), sep), blank)
    return cvs.select(
        key,
        F.struct(T.shown_text(identity["label"]).alias("title"), F.coalesce(T.shown_text(identity["summary"]), T.shown_text(F.col("profile_summary.summary"))).alias("summary")).alias("career_identity"),
        F.transform("education", lambda e: F.struct(joined(F.array(e["degree_type"], e["field_of_study"]), " in ").alias("degree"), _null().alias("institution"), T.shown_year(e["start_date"]).alias("start_year"), T.shown_year(e["end_date"]).alias("end_year"))).alias("education"),
        F.transform("experience", lambda e: F.struct(T.shown_text(e["role"]).alias("role"), _null().alias("organization"), T.shown_text(e["start_date"]).alias("start_date"), T.shown_text(e["end_date"]).alias("end_date"), joined(e["core_responsibilities"], "; ").alias("summary"), T.shown_distinct(e["contextual_skills"]).alias("skills"))).alias("experience"),
        T.shown_distinct(names).alias("skills"),
        T.shown_distinct(F.flatten(F.transform(_strings(F.col("interests")), lambda i: F.split(i, "[,;\n]")))).alias("interests"),
        F.transform("certifications", lambda c: F.struct(T.shown_text(c["name"]).alias("name"), T.shown_text(c["issuing_organization"]).alias("issuer"), T.shown_year(c["issue_date"]).alias("year"))).alias("certifications"),
        F.transform("projects", lambda p: F.struct(T.shown_text(p["title"]).alias("title"), joined(F.array(p["description"], F.nullif(F.array_join(p["outcomes"], "; "), blank)), "; ").alias("summary"), T.shown_distinct(p["technologies"]).alias("technologies"), T.shown_year(F.coalesce(p["start_date"], p["end_date"])).alias("year"))).alias("projects"),
        F.coalesce(T.shown_text(F.col("potential_direction")), blank).alias("potential_direction"),
    )


def _any_text(*values: Column) -> Column:
    out = F.lit(False)
    for v in values:
        out = out | (F.coalesce(F.trim(v), F.lit("")) != "")
    return out


def validity(profiles: DataFrame) -> Column:
    """Null for a profile with a sign of ability and one of intent, else what is missing."""
    any_of = lambda items, *names: F.exists(items, lambda x: _any_text(*[x[n] for n in names]))
    listed = lambda values: F.exists(_strings(values), lambda v: _any_text(v))
    able = (
        any_of("experience", "role", "organization", "start_date", "end_date", "summary")
        | F.exists("experience", lambda e: listed(e["skills"]))
        | any_of("education", "degree", "institution", "start_year", "end_year")
        | listed(F.col("skills"))
        | any_of("certifications", "name", "issuer", "year")
        | any_of("projects", "title", "summary", "year")
        | F.exists("projects", lambda p: listed(p["technologies"]))
    )
    intent = _any_text(F.col("career_identity.title"), F.col("career_identity.summary"), F.col("potential_direction")) | listed(F.col("interests"))
    return (
        F.when(~able & ~intent, "Profile must include at least one capability signal and one intent signal.")
        .when(~able, "Profile must include at least one capability signal from experience, education, skills, certifications, or projects.")
        .when(~intent, "Profile must include at least one intent signal from career identity or interests.")
    )


def manual_profile(forms: DataFrame, most: int = 50, key: str = "profile_id") -> DataFrame:
    """Documents from hand-written forms (current_role, seniority_level, years_of_experience, summary, lists), with ``error`` for those that lack a role, a skill or an interest."""
    trimmed = lambda x: F.nullif(F.trim(x), F.lit(""))
    kept = lambda items, name, make: F.transform(F.filter(F.slice(items, 1, most), lambda x: trimmed(x[name]).isNotNull()), make)
    technical, interests = T.trimmed_distinct(F.col("technical_skills"), most), T.trimmed_distinct(F.col("interests"), most)
    role = trimmed(F.col("current_role"))
    error = F.when(role.isNull(), "Provide your current role.").when(F.size(technical) == 0, "Provide at least one technical skill.").when(F.size(interests) == 0, "Provide at least one interest.")
    # languages: the first of each name, its level with it
    spoken = F.filter(F.transform("languages", lambda x: F.struct(F.trim(x["language"]).alias("language"), trimmed(x["level"]).alias("level"))), lambda x: x["language"] != "")
    names = F.transform(spoken, lambda x: F.lower(x["language"]))
    languages = F.slice(F.filter(spoken, lambda x, i: F.array_position(names, F.lower(x["language"])) == i + 1), 1, most)
    job = lambda x: F.struct(trimmed(x["role"]).alias("role"), trimmed(x["organization"]).alias("organization"), F.array_compact(F.array(trimmed(x["description"]))).alias("core_responsibilities"), trimmed(x["start_date"]).alias("start_date"), trimmed(x["end_date"]).alias("end_date"))
    return forms.select(
        key,
        error.alias("error"),
        F.struct(role.alias("current_role")).alias("personal_info"),
        F.struct(trimmed(F.col("summary")).alias("summary"), trimmed(F.col("seniority_level")).alias("current_seniority_level"), "years_of_experience").alias("profile_summary"),
        kept("experience", "role", job).alias("experience"),
        F.struct(F.transform(technical, lambda n: F.struct(n.alias("name"))).alias("technical_skills"), F.transform(T.trimmed_distinct(F.col("soft_skills"), most), lambda n: F.struct(n.alias("name"), F.lit(100.0).alias("confidence"))).alias("soft_skills"), languages.alias("languages")).alias("skills_extracted"),
        interests.alias("interests"),
    )


def _lines(items: str, label: str, *parts: Callable[[Column], Column]) -> Column:
    """``label i: parts`` of each item that has any; the number counts skipped items too."""
    line = lambda x, i: F.concat(F.lit(f"{label} "), (i + 1).cast("string"), F.lit(": "), T.joined_distinct(F.array(*[p(x) for p in parts])))
    return F.array_compact(F.transform(items, line))


def _named(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), value)


def capability_text(profiles: DataFrame, most: int = 700) -> Column:
    """What a profile can do, as text to embed."""
    head = F.array_compact(F.array(_named("Skills", T.joined_distinct(F.col("skills"), 30))))
    summary = lambda x: _named("Summary", T.truncate_words(x["summary"], most))
    lines = F.concat(
        head,
        _lines("experience", "Experience", lambda x: x["role"], summary, lambda x: _named("Skills", T.joined_distinct(x["skills"]))),
        _lines("projects", "Project", lambda x: x["title"], summary, lambda x: _named("Technologies", T.joined_distinct(x["technologies"]))),
        _lines("certifications", "Certification", lambda x: x["name"]),
        _lines("education", "Education", lambda x: x["degree"]),
    )
    return F.array_join(lines, "\n")


def intent_text(profiles: DataFrame, most: int = 700) -> Column:
    """Where a profile may go, as text to embed."""
    return F.array_join(F.array_compact(F.array(_named("Interests", T.joined_distinct(F.col("interests"), 20)), _named("Potential direction", T.truncate_words(F.col("potential_direction"), most)))), "\n")


def identity_text(profiles: DataFrame, most: int = 700) -> Column:
    """Who a profile is, as text to embed."""
    title = F.nullif(F.trim("career_identity.title"), F.lit(""))
    return F.array_join(F.array_compact(F.array(_named("Career identity", title), _named("Career summary", T.truncate_words(F.col("career_identity.summary"), most)))), "\n")


def role_texts(title: Column, description: Column, skills: Column, certifications: Column, raw_certifications: Column, domain_tags: Column) -> tuple[Column, Column]:
    """Capability and intent texts of a role."""
    blank = F.lit("")
    name = F.coalesce(T.clean_text(title), blank)
    able = F.array_compact(F.array(_named("Job title", name), _named("Required skills", T.clean_text(skills)), _named("Certifications", T.first_text(certifications, raw_certifications)), _named("Responsibilities", T.truncate_words(description, 1200))))
    aim = F.array_compact(F.array(_named("Career direction", name), _named("Domain tags", T.clean_text(domain_tags)), _named("Role context", T.truncate_words(description, 700))))
    return F.trim(F.array_join(able, "\n")), F.trim(F.array_join(aim, "\n"))


def evidence(cvs: DataFrame, key: str = "profile_id") -> DataFrame:
    """(key, explicit, context): skills that a document names, and texts that may mention some, each once.

    A thesis section and the thesis titles of the education count where documents have them.
    """
    thesis = "thesis" in cvs.columns
    titles = lambda x: [x["thesis_title"]] if "thesis_title" in cvs.schema["education"].dataType.elementType.names else []
    flat = lambda items, name: F.flatten(F.transform(items, lambda x: _strings(x[name])))
    each = lambda items, *names: F.flatten(F.transform(items, lambda x: F.array(*[x[n] for n in names])))
    skills = F.col("skills_extracted")
    explicit = F.concat(*[F.transform(skills[s], lambda x: x["name"]) for s in ("technical_skills", "inferred_skills", "soft_skills")], flat("experience", "contextual_skills"), flat("projects", "technologies"), *([flat("thesis", "technologies")] if thesis else []))
    context = F.concat(
        F.array("personal_info.current_role", "profile_summary.summary", "profile_summary.current_seniority_level"),
        _strings(F.col("interests")),
        F.flatten(F.transform("experience", lambda x: F.concat(F.array(x["role"], x["industry"]), _strings(x["core_responsibilities"])))),
        F.flatten(F.transform("education", lambda x: F.concat(F.array(x["degree_type"], x["field_of_study"], x["institution"], *titles(x)), _strings(x["courses"])))),
        F.flatten(F.transform("projects", lambda x: F.concat(F.array(x["title"], x["description"], x["role"]), _strings(x["outcomes"])))),
        *([F.flatten(F.transform("thesis", lambda x: F.array(x["title"], x["degree_type"], x["institution"], x["description"])))] if thesis else []),
    )
    return cvs.select(key, T.clean_distinct(explicit).alias("explicit"), T.clean_distinct(context).alias("context"))


def section_skills(cvs: DataFrame, key: str = "profile_id") -> DataFrame:
    """(key, skills): technical skills, then those of projects, thesis and jobs, the first spelling of each."""
    flat = lambda items, name: F.flatten(F.transform(items, lambda x: _strings(x[name])))
    sections = [F.transform("skills_extracted.technical_skills", lambda s: s["name"]), flat("projects", "technologies"), flat("experience", "contextual_skills")]
    if "thesis" in cvs.columns:
        sections.insert(2, flat("thesis", "technologies"))
    return cvs.select(key, T.clean_distinct(F.concat(*sections)).alias("skills"))


#: Raised when the preparation of skills changes, so that what was stored before is made anew.
PREPARED_VERSION = 1


def prepared_of(cvs: DataFrame, prepare: Callable[[DataFrame, DataFrame], DataFrame], stored: DataFrame | None = None, key: str = "profile_id") -> DataFrame:
    """Prepared skills of every document, with ``version``: stored ones where they are of this version, else prepared from its evidence.

    ``prepare`` takes rows (key, term, ord) of the explicit and of the context terms.  A document
    that has no evidence has no rows.  The evidence is written once: ``prepare`` reads its terms several times.
    """
    todo = cvs
    if stored is not None:
        stored = stored.filter(F.col("version") == PREPARED_VERSION)
        todo = cvs.join(stored.select(key).distinct(), key, "left_anti")
    found = cut(evidence(todo, key), "evidence")
    made = prepare(terms(found, "explicit", key), terms(found, "context", key)).withColumn("version", F.lit(PREPARED_VERSION))
    return made if stored is None else made.unionByName(stored.join(cvs.select(key), key, "left_semi").select(*made.columns))


def terms(rows: DataFrame, column: str, key: str = "profile_id") -> DataFrame:
    """(key, term, ord) of an array of texts."""
    return rows.select(key, F.posexplode(column).alias("ord", "term")).select(key, "term", "ord")


def comparable_fields(cvs: DataFrame, key: str = "profile_id") -> DataFrame:
    """(key, field, values): the fields of a document that can be compared with a labelled one."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    single = {"full_name": "personal_info.full_name", "email": "personal_info.email", "phone": "personal_info.phone", "current_role": "personal_info.current_role", "profile_summary": "profile_summary.summary", "current_seniority_level": "profile_summary.current_seniority_level", "years_of_experience": "profile_summary.years_of_experience"}
    one = lambda items, name: F.filter(F.transform(items, lambda x: x[name]), lambda v: F.coalesce(F.trim(v), F.lit("")) != "")
    many = lambda items, name: F.filter(F.flatten(F.transform(items, lambda x: _strings(x[name]))), lambda v: F.trim(v) != "")
    parts = lambda x, *names: F.nullif(F.concat_ws(" ", *[F.nullif(F.trim(x[n]), F.lit("")) for n in names]), F.lit(""))
    dates = lambda items: F.filter(F.transform(items, lambda x: T.date_range(x["start_date"], x["end_date"])), lambda v: v != "")
    skills = F.col("skills_extracted")
    fields = {
        **{k: F.array(text(v)) for k, v in single.items()},
        "experience_roles": one("experience", "role"),
        "experience_organizations": one("experience", "organization"),
        "experience_industries": one("experience", "industry"),
        "experience_locations": one("experience", "location"),
        "experience_date_ranges": dates("experience"),
        "experience_responsibilities": many("experience", "core_responsibilities"),
        "experience_contextual_skills": many("experience", "contextual_skills"),
        "education_entry_types": one("education", "entry_type"),
        "education": F.array_compact(F.transform("education", lambda x: parts(x, "degree_type", "field_of_study"))),
        "education_institutions": one("education", "institution"),
        "education_date_ranges": dates("education"),
        "education_grades": one("education", "grade"),
        "education_courses": many("education", "courses"),
        "skills": F.concat(F.transform(skills["technical_skills"], lambda s: s["name"]), F.transform(skills["soft_skills"], lambda s: s["name"])),
        "languages": F.array_compact(F.transform(skills["languages"], lambda x: parts(x, "language", "level"))),
        "interests": F.filter(_strings(F.col("interests")), lambda v: F.trim(v) != ""),
        "projects": one("projects", "title"),
        "project_organizations": one("projects", "organization"),
        "project_roles": one("projects", "role"),
        "project_descriptions": one("projects", "description"),
        "project_technologies": many("projects", "technologies"),
        "project_outcomes": many("projects", "outcomes"),
        "project_links": many("projects", "links"),
        "project_date_ranges": dates("projects"),
        "certifications": one("certifications", "name"),
        "certification_issuers": one("certifications", "issuing_organization"),
        "certification_issue_dates": one("certifications", "issue_date"),
        "certification_expiration_dates": one("certifications", "expiration_date"),
    }
    if "thesis" in cvs.columns:
        fields |= {"thesis_titles": one("thesis", "title"), "thesis_technologies": many("thesis", "technologies")}
    info = cvs.schema["personal_info"].dataType.names
    if "location" in info:
        single["location"] = "personal_info.location"
        fields["location"] = F.array(text(single["location"]))
    if "links" in info:
        fields["links"] = _strings(F.col("personal_info.links"))
    rows = F.array(*[F.struct(F.lit(k).alias("field"), v.cast(STRINGS).alias("values"), F.lit(k in single).alias("single")) for k, v in fields.items()])
    return cvs.select(key, F.inline(rows))


def field_scores(expected: DataFrame, actual: DataFrame, key: str = "profile_id") -> DataFrame:
    """(key, field, score) of labelled fields (key, field, values, single) against those of a document."""
    from .metrics import list_scores, scalar_score

    x = expected.join(actual.select(key, "field", F.col("values").alias("_found")), [key, "field"], "left")
    first = lambda c: F.coalesce(F.get(F.col(c), F.lit(0)), F.lit(""))
    x = list_scores(x, "values", "_found")
    return x.select(key, "field", F.when(F.col("single"), scalar_score(first("values"), first("_found"))).otherwise(F.col("f1")).alias("score"))


def stages(cvs: DataFrame, identity: Column | None = None, key: str = "profile_id") -> dict[str, DataFrame]:
    """The steps of preparing documents, each a table: parsed, stripped, identity, embedding profile, confirmed.

    ``identity``: struct of label and summary that a model made; where it is null, or none is
    given, the identity comes from the document.
    """
    stripped = privacy_stripped(cvs)
    made = fallback_identity(stripped)
    who = made if identity is None else F.coalesce(identity, made)
    return {
        "01_parsed": cvs,
        "02_stripped": stripped,
        "03_identity": stripped.select(key, who.alias("identity")),
        "04_embedding_profile": embedding_profile(stripped, who, key),
        "05_confirmed": confirmed(cvs, who, key),
    }


def write_stages(tables: dict[str, DataFrame], folder: str) -> list[str]:
    """Each step as JSON files under its name; the paths."""
    out = []
    for name, df in tables.items():
        out.append(f"{folder.rstrip('/')}/{name}")
        df.write.mode("overwrite").json(out[-1])
    return out


def read_stage(folder: str, like: DataFrame) -> DataFrame:
    """A step that :func:`write_stages` wrote, in the schema of ``like``; a document that does not fit fails the read."""
    return like.sparkSession.read.schema(like.schema).option("mode", "FAILFAST").json(folder)


def run_pipeline(cvs: DataFrame, folder: str, prepare: Callable[[DataFrame, DataFrame], DataFrame], identity: Column | None = None, key: str = "profile_id") -> dict[str, DataFrame]:
    """All steps, each written under ``folder`` and read back before the next one, down to ``06_prepared``: the skills to match with.

    A step that was written stays as it is when a later one fails; a run writes all of them anew.
    """
    parsed = read_stage(write_stages({"01_parsed": cvs}, folder)[0], cvs)
    steps = stages(parsed, identity, key)
    paths = write_stages({k: v for k, v in steps.items() if k != "01_parsed"}, folder)
    out = {"01_parsed": parsed} | {n: read_stage(p, steps[n]) for n, p in zip([k for k in steps if k != "01_parsed"], paths, strict=True)}
    made = prepared_of(unwrapped(out["05_confirmed"].select(key, "confirmed_cv_data")), prepare, None, key)
    return out | {"06_prepared": read_stage(write_stages({"06_prepared": made}, folder)[0], made)}


def profile_line(statement: Column, role: Column, summary: Column) -> Column:
    """One line on a profile: its statement, else role and summary, else what there is."""
    s, r, t = T.clean_text(statement), T.clean_text(role), T.clean_text(summary)
    return F.coalesce(s, F.concat(r, F.lit(": "), t), t, r, F.lit("Current profile"))
