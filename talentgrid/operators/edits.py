"""Edits of nested documents: ordered logs of single changes, and positional merges of whole lists.

A log holds (key, seq, op, path, value) rows.  The rows of one document are applied in order of seq
(ties: op, path, value), each to what the ones before it left.  An edit whose target is not there,
or whose result would not fit the documents' schema, changes nothing and is reported.  Documents
are told apart by their key alone, so they are edited in parallel; one log is folded by one task,
as each edit depends on the last.

Operations: ``set`` (blank: null), ``replace`` (JSON only where the section is no text), ``append`` and ``delete`` (of a list's
item), ``confirm`` and ``skip`` (of a section), ``quit`` (the whole confirmation ends without a
result).  Values are JSON, or plain text where they are none.  Paths are names and list positions
from 0, by dots.

Lists that were edited as a whole are merged by position: fields that the view shows come from the
edit, the others from the item of the base at that place.  All of that is column expressions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import text as T
from ..shipping import ship

#: Sections in the order in which they are confirmed, with their paths.
SECTIONS = {
    "personal_info": "personal_info",
    "profile_summary": "profile_summary",
    "experience": "experience",
    "education": "education",
    "projects": "projects",
    "certifications": "certifications",
    "thesis": "thesis",
    "technical_skills": "skills_extracted.technical_skills",
    "soft_skills": "skills_extracted.soft_skills",
    "languages": "skills_extracted.languages",
    "interests": "interests",
    "unmapped_information": "unmapped_information",
}
#: Confidence of a proficiency by the first of these words in it, else the last.
CONFIDENCE = {"expert": 90, "advanced": 80, "intermediate": 70, "beginner": 50}
UNKNOWN_CONFIDENCE = 65
#: What a view shows for a missing value, and for an end that is open.
DASH, OPEN = "—", "Present"

RESULT = "doc string, confirmed array<string>, skipped array<string>, edited array<string>, rejected array<struct<seq:long,reason:string>>, cancelled boolean"


class Rejected(Exception):
    """An edit that cannot be made."""


def fits(value, kind: S.DataType) -> bool:
    """Whether a JSON value can be read as a Spark type; null fits anything."""
    if value is None:
        return True
    if isinstance(kind, S.StructType):
        known = {f.name: f.dataType for f in kind}
        return isinstance(value, dict) and all(k in known and fits(v, known[k]) for k, v in value.items())
    if isinstance(kind, S.ArrayType):
        return isinstance(value, list) and all(fits(v, kind.elementType) for v in value)
    if isinstance(kind, S.StringType):
        return isinstance(value, str)
    if isinstance(kind, S.BooleanType):
        return isinstance(value, bool)
    if isinstance(kind, S.IntegralType):
        return isinstance(value, int) and not isinstance(value, bool)
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def _place(part: str, length: int) -> int:
    if not part.isdigit() or int(part) >= length:
        raise Rejected(f"no item {part}")
    return int(part)


def target(doc, kind: S.DataType, path: list[str]) -> tuple[object, S.DataType]:
    """The value at a path and the type it has in the schema."""
    for part in path:
        if isinstance(kind, S.StructType):
            if part not in kind.names:
                raise Rejected(f"no field {part}")
            doc, kind = (doc or {}).get(part), kind[part].dataType
        elif isinstance(kind, S.ArrayType):
            doc, kind = (doc or [])[_place(part, len(doc or []))], kind.elementType
        else:
            raise Rejected(f"nothing below {part}")
    return doc, kind


def _value(text: str | None, blank_is_null: bool):
    if text is None or blank_is_null and not text.strip():
        return None
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        return text


def edited(doc: dict, kind: S.StructType, op: str, path: str, text: str | None) -> None:
    """Make one edit in place, or raise :class:`Rejected` and leave the document alone."""
    steps = path.split(".") if path else []
    if not steps:
        raise Rejected("no path")
    if op in ("set", "replace"):
        _, leaf = target(doc, kind, steps)
        value = _value(text, op == "set")
        if not fits(value, leaf):
            raise Rejected(f"value does not fit {leaf.simpleString()}"[:60])
        held, above = target(doc, kind, steps[:-1])
        if held is None:
            raise Rejected(f"nothing at {'.'.join(steps[:-1])}")
        held[int(steps[-1]) if isinstance(above, S.ArrayType) else steps[-1]] = value
    elif op == "append":
        held, leaf = target(doc, kind, steps)
        if not isinstance(leaf, S.ArrayType) or held is None:
            raise Rejected("not a list")
        value = _value(text, False)
        if not fits(value, leaf.elementType):
            raise Rejected(f"value does not fit {leaf.elementType.simpleString()}"[:60])
        held.append(value)
    elif op == "delete":
        held, above = target(doc, kind, steps[:-1])
        if not isinstance(above, S.ArrayType) or held is None:
            raise Rejected("not a list")
        del held[_place(steps[-1], len(held))]
    else:
        raise Rejected(f"no operation {op}")


def folded(doc: dict, kind: S.StructType, log: list[dict]) -> tuple:
    """A document after its log: (doc, confirmed, skipped, edited, rejected, cancelled)."""
    confirmed, skipped, changed, rejected, cancelled = [], [], [], [], False
    for e in log:
        op, path = e["op"] or "", e["path"] or ""
        if op == "quit":
            cancelled = True
            break
        try:
            if op in ("confirm", "skip"):
                if path not in SECTIONS or path in confirmed or path in skipped:
                    raise Rejected(f"no open section {path}")
                (confirmed if op == "confirm" else skipped).append(path)
                continue
            edited(doc, kind, op, path, e["value"])
            # what is named is the field, or the list that gained or lost an item
            changed.append(path.rpartition(".")[0] if op == "delete" else path)
        except Rejected as why:
            rejected.append({"seq": e["seq"], "reason": str(why)})
    return doc, confirmed, skipped, changed, rejected, cancelled


def apply_edits(docs: DataFrame, edits: DataFrame, key: str = "profile_id", assume_yes: bool = False) -> DataFrame:
    """(key, doc, confirmed, skipped, edited, rejected, cancelled) of every document.

    ``docs``: the key and the sections as columns; ``doc`` is a struct of them again, as they are
    after the log, and null if the log has quit.  With ``assume_yes`` every section that is there
    counts as confirmed and no log is read.  Edits of unknown documents, and rows without a seq, change nothing.
    """
    ship(docs.sparkSession)
    sections = [c for c in docs.columns if c != key]
    kind = S.StructType([docs.schema[c] for c in sections])
    plain = docs.select(key, F.to_json(F.struct(*sections), {"ignoreNullFields": "false"}).alias("doc"))
    if assume_yes:
        named = [s for s, p in SECTIONS.items() if p.split(".")[0] in sections]
        empty = F.array().cast("array<string>")
        none = F.array().cast("array<struct<seq:long,reason:string>>")
        return docs.select(key, F.struct(*sections).alias("doc"), F.array(*map(F.lit, named)).alias("confirmed"), empty.alias("skipped"), empty.alias("edited"), none.alias("rejected"), F.lit(False).alias("cancelled"))
    row = F.struct(F.col("seq").cast("long").alias("seq"), "op", "path", F.col("value").cast("string").alias("value"))
    logs = edits.filter("seq is not null").groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("log"))
    both = plain.join(logs, key, "left")
    schema = S.StructType([both.schema[key], *S.StructType.fromDDL(RESULT).fields])
    names = RESULT.split(", ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out_schema = to_arrow_schema(schema)
        for b in batches:
            rows = [folded(json.loads(d), kind, log or []) for d, log in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            columns[0] = [json.dumps(d, ensure_ascii=False) for d in columns[0]]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(out_schema.field(0).type), *[pa.array(list(c), f.type) for c, f in zip(columns, list(out_schema)[1:], strict=True)]], schema=out_schema)

    done = both.select(key, "doc", "log").mapInArrow(run, schema)
    return done.withColumn("doc", F.when(~F.col("cancelled"), F.from_json("doc", kind, {"mode": "FAILFAST"})))


# lists edited as a whole


def _or(x: Column, other: str) -> Column:
    return F.coalesce(x, F.lit(other))


def year_of(x: Column, missing: str = DASH) -> Column:
    """The first four digits of a date, else the date as it is; ``missing`` where there is none."""
    found = F.regexp_extract(x, r"\d{4}", 0)
    return F.when(F.coalesce(x, F.lit("")) == "", missing).when(found != "", found).otherwise(x)


def confidence(proficiency: Column) -> Column:
    """A number for a proficiency in words."""
    said = F.lower(proficiency)
    scores = [F.when(F.contains(said, F.lit(word)), score) for word, score in CONFIDENCE.items()]
    return F.coalesce(*scores, F.lit(UNKNOWN_CONFIDENCE))


def interests(values: Column) -> Column:
    """Texts split at commas, semicolons and lines, trimmed, the first spelling of each."""
    return T.shown_distinct(F.flatten(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.split(_or(v, ""), r"[,;\n]"))))


def _trimmed(values: Column) -> Column:
    return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: v != "")


def recap(cvs: DataFrame, key: str = "profile_id", proficiency: str = "proficiency") -> DataFrame:
    """(key, skills, interests, experiences, educations, certifications, projects): documents as they are shown for editing."""
    job = lambda e: F.struct(_or(e["role"], "Role").alias("role"), _or(e["organization"], DASH).alias("company"), F.array_join(_trimmed(e["core_responsibilities"]), "; ").alias("summary"), year_of(e["start_date"]).alias("start"), year_of(e["end_date"], OPEN).alias("end"))
    school = lambda e: F.struct(_or(e["degree_type"], "").alias("degree"), _or(e["field_of_study"], "").alias("field"), _or(e["institution"], DASH).alias("school"), year_of(e["start_date"]).alias("start"), year_of(e["end_date"]).alias("end"))
    cert = lambda c: F.struct(_or(c["name"], "Certification").alias("name"), _or(c["issuing_organization"], DASH).alias("issuer"), year_of(c["issue_date"]).alias("year"))
    project = lambda p: F.struct(_or(p["title"], "Project").alias("name"), _or(p["description"], DASH).alias("detail"), _trimmed(p["technologies"]).alias("technologies"), year_of(p["start_date"]).alias("start"), year_of(p["end_date"]).alias("end"))
    return cvs.select(
        key,
        F.transform("skills_extracted.technical_skills", lambda s: F.struct(s["name"].alias("name"), confidence(s[proficiency]).alias("confidence"))).alias("skills"),
        interests(F.col("interests")).alias("interests"),
        F.transform("experience", job).alias("experiences"),
        F.transform("education", school).alias("educations"),
        F.transform("certifications", cert).alias("certifications"),
        F.transform("projects", project).alias("projects"),
    )


def _merged(edits: Column, base: Column, kind: S.ArrayType, new) -> Column:
    """The edited items, each with the other fields of the base's item at its place (nulls and empty lists beyond its end)."""

    def one(e: Column, i: Column) -> Column:
        old, fields = F.get(base, i), new(e)
        rest = lambda f: F.coalesce(old[f.name], F.array().cast(f.dataType)) if isinstance(f.dataType, S.ArrayType) else old[f.name]
        return F.struct(*[(fields[f.name].cast(f.dataType) if f.name in fields else rest(f)).alias(f.name) for f in kind.elementType])

    return F.transform(edits, one)


def merge_edits(cvs: DataFrame, edits: DataFrame, key: str = "profile_id", proficiency: str = "proficiency") -> DataFrame:
    """The documents, with the lists of ``edits`` (as of :func:`recap`) merged over theirs by position.

    A longer list gains items of which only the shown fields are known; a shorter one loses the
    last ones.  A skill keeps its proficiency by its name, not its place.  Documents without edits
    stay as they are; a null list in an edit leaves that section alone.
    """
    shown = lambda x, *gone: F.when(~x.isin(*gone), x)
    filled = lambda x: F.nullif(F.trim(x), F.lit(""))
    rules = {
        "experience": ("experiences", lambda e: {"role": e["role"], "organization": e["company"], "core_responsibilities": F.array_compact(F.array(filled(e["summary"]))), "start_date": shown(e["start"], DASH), "end_date": shown(e["end"], DASH, OPEN)}),
        "education": ("educations", lambda e: {"degree_type": filled(e["degree"]), "field_of_study": filled(e["field"]), "institution": e["school"], "start_date": shown(e["start"], DASH), "end_date": shown(e["end"], DASH)}),
        "projects": ("projects", lambda p: {"title": p["name"], "description": filled(shown(p["detail"], DASH)), "technologies": F.coalesce(p["technologies"], F.array().cast("array<string>")), "start_date": filled(shown(p["start"], DASH)), "end_date": filled(shown(p["end"], DASH))}),
        "certifications": ("certifications", lambda c: {"name": c["name"], "issuing_organization": shown(c["issuer"], DASH), "issue_date": shown(c["year"], DASH)}),
    }
    sections = [c for c in edits.columns if c != key]
    both = cvs.join(edits.select(key, F.struct(*sections).alias("_edit")), key, "left")
    changed = {c: F.coalesce(_merged(F.col("_edit")[source], F.col(c), cvs.schema[c].dataType, new), F.col(c)) for c, (source, new) in rules.items()}
    held = F.col("skills_extracted.technical_skills")
    kind = cvs.schema["skills_extracted"].dataType["technical_skills"].dataType
    known = lambda s: F.get(F.filter(held, lambda t: t["name"] == s["name"]), F.lit(0))[proficiency]
    skills = F.transform(F.col("_edit.skills"), lambda s: F.struct(*[(s["name"] if f.name == "name" else known(s) if f.name == proficiency else F.lit(None).cast(f.dataType)).alias(f.name) for f in kind.elementType]))
    changed["skills_extracted"] = F.col("skills_extracted").withField("technical_skills", F.coalesce(skills, held))
    changed["interests"] = F.when(F.col("_edit.interests").isNull(), F.col("interests")).otherwise(interests(F.col("_edit.interests")))
    return both.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in cvs.columns])
