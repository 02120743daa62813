"""Chat formatting by schema fingerprints.

Records come as JSON in different layouts (one turn per record, message lists, prompt and
response, instruction with input and output).  The sorted set of a record's nested field
paths is hashed; the hash selects a declarative :class:`Mapping` that says where roles and
texts are.  All layouts end as canonical turns (conversation, position, role, text).

The template writes a turn as ``<|im_start|>role`` newline text ``<|im_end|>`` newline.
Control strings inside roles and texts are escaped: a backslash is doubled, and one is put
after the first character of every control string; dropping the first of each pair undoes
it.  The loss mask is the span of the escaped text of each assistant turn.

The output has one row per turn, so a conversation of any length is never held as a whole;
reading back streams the rows in order with running digests.

Defined results: a null text is empty, a null role is the empty role; turns with the same
number go by role and text; a record whose layout no mapping knows raises an error; extra
columns of the turn table are ignored; an empty table gives the rows of no conversation.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_hexdigest

from .common import ship, table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Strings that mark turns in this and other public chat templates.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPED = re.compile(r"\\(.)", re.S)


@dataclass(frozen=True)
class Mapping:
    """Where the turns of a layout are.

    ``each``: field of the list of turns ('' if the record is one turn); ``role`` and
    ``text``: fields of a turn; ``fixed``: (role, fields) pairs for layouts without role
    fields, the non-empty fields joined by a newline; ``roles``: names to canonical roles.
    """

    paths: tuple[str, ...]
    each: str | None = None
    role: str = ""
    text: str = ""
    position: str = ""
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: tuple[tuple[str, str], ...] = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"))


def paths_of(value, prefix: str = "") -> set[str]:
    """Nested field paths; ``[]`` stands for any element of a list."""
    if isinstance(value, dict):
        found: set[str] = set()
        for k, v in value.items():
            found |= paths_of(v, f"{prefix}.{k}" if prefix else str(k))
        return found or {prefix}
    if isinstance(value, list):
        found = set()
        for v in value:
            found |= paths_of(v, prefix + "[]")
        return found or {prefix + "[]"}
    return {prefix}


def fingerprint(paths) -> str:
    """Hash of a set of field paths."""
    return xxh64_hexdigest("\n".join(sorted(set(paths))))


MAPPINGS = (
    Mapping(("turn", "role", "text"), each="", role="role", text="text", position="turn", roles=()),  # canonical already: roles stay
    Mapping(("messages[].role", "messages[].content"), each="messages", role="role", text="content"),
    Mapping(("conversations[].from", "conversations[].value"), each="conversations", role="from", text="value"),
    Mapping(("prompt", "completion"), fixed=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping(("prompt", "response"), fixed=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping(("system", "prompt", "response"), fixed=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping(("instruction", "output"), fixed=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping(("instruction", "input", "output"), fixed=(("user", ("instruction", "input")), ("assistant", ("output",)))),
)


def turns_of(record: dict, table_: dict[str, Mapping]) -> Iterator[tuple[int, str, str]]:
    """Canonical (position, role, text) of one record."""
    m = table_.get(fingerprint(paths_of(record)))
    if m is None:
        raise ValueError(f"no mapping for the layout {sorted(paths_of(record))}")
    names = dict(m.roles)
    if m.fixed:
        for i, (role, fields) in enumerate(m.fixed):
            yield i, role, "\n".join(x for f in fields if (x := record[f] or ""))
        return
    for i, t in enumerate([record] if m.each == "" else record[m.each]):
        role = t[m.role] or ""
        yield (t[m.position] or 0) if m.position else i, names.get(role, role), t[m.text] or ""


def canonical_turns(records: DataFrame, conv: str = "conv_id", payload: str = "payload", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(conv_id, position, role, text) of (conv, JSON payload) rows in any known layout."""
    ship(records.sparkSession)
    table_ = {fingerprint(m.paths): m for m in mappings}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(c, *t) for c, p in zip(*(x.to_pylist() for x in b.columns), strict=True) for t in turns_of(json.loads(p), table_)]
            cols = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], names=["conv_id", "position", "role", "text"])

    return records.select(conv, payload).mapInArrow(run, "conv_id long, position long, role string, text string")


def escape(text: str) -> str:
    """Text without control strings, reversibly."""
    text = text.replace("\\", "\\\\")
    for c in CONTROLS:
        text = text.replace(c, c[0] + "\\" + c[1:])
    return text


def unescape(text: str) -> str:
    """Undo :func:`escape`."""
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def segment(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn and the span of its loss mask (0, 0 if it has none)."""
    head = OPEN + escape(role).replace("\n", "\\\n") + "\n"
    body = escape(text)
    span = (len(head), len(head) + len(body)) if role == "assistant" else (0, 0)
    return head + body + CLOSE, *span


_HEAD = re.compile(re.escape(OPEN) + r"((?:[^\\\n]|\\.)*)\n", re.S)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn in a formatted string."""
    at = 0
    while at < len(formatted):
        head = _HEAD.match(formatted, at)
        if head is None:
            raise ValueError("not a turn")
        end = formatted.index(CLOSE, head.end())
        yield unescape(head[1]), unescape(formatted[head.end() : end])
        at = end + len(CLOSE)


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, position, formatted, loss_start, loss_end) of canonical turns, in any order."""
    ship(turns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            segs = [segment(r or "", t or "") for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            cols = list(zip(*segs, strict=True)) if segs else [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["conv_id", "position", "formatted", "loss_start", "loss_end"])

    return turns.select("conv_id", "position", "role", "text").mapInArrow(run, "conv_id long, position long, formatted string, loss_start long, loss_end long")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests per conversation from formatted rows, streamed in order."""
    ship(formatted.sparkSession)

    class State:
        def __init__(self, conv):
            self.conv, self.n, self.chars, self.loss = conv, 0, 0, 0
            self.turns, self.masked = hashlib.sha256(), hashlib.sha256()

        def row(self):
            return self.conv, self.n, self.turns.hexdigest(), self.loss, self.masked.hexdigest(), self.chars

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        c = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, out = None, []
        for b in batches:
            cols = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
            for conv, text, s, e in zip(cols["conv_id"], cols["formatted"], cols["loss_start"], cols["loss_end"], strict=True):
                if state is None or conv != state.conv:
                    if state is not None:
                        out.append(state.row())
                    state = State(conv)
                for role, body in parse(text):
                    state.n += 1
                    state.turns.update(f"{role}\n{body}\n".encode())
                under = unescape(text[s:e])
                state.loss += len(under)
                state.masked.update(under.encode())
                state.chars += len(text)
            if len(out) >= 5000:
                yield batch(out)
                out = []
        if state is not None:
            out.append(state.row())
        if out:
            yield batch(out)

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "position", "formatted")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def turn_records(conversations: DataFrame) -> DataFrame:
    """A table of turns as JSON records of the one-turn layout."""
    turn = F.struct("turn", "role", "text")
    return conversations.select("conv_id", F.to_json(turn, {"ignoreNullFields": "false"}).alias("payload"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1 with control strings in both turns."""
    odd = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(format_turns(canonical_turns(turn_records(rows))))


def oracle() -> str:
    """DuckDB SQL for the same rows, from the texts themselves."""
    esc = "replace({}, chr(92), chr(92) || chr(92))"
    for c in CONTROLS:
        esc = f"replace({esc}, '{c}', '{c[0]}' || chr(92) || '{c[1:]}')"
    text, role = esc.format("text"), esc.format("role")
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
d AS (
  SELECT *, {len(OPEN) + 1 + len(CLOSE)} + length({text}) + length(replace({role}, chr(10), chr(92) || chr(10))) AS chars,
         CASE WHEN role = 'assistant' THEN text ELSE '' END AS masked FROM c)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       sum(length(masked))::BIGINT AS loss_chars, sha256(string_agg(masked, '' ORDER BY turn)) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM d GROUP BY conv_id
"""
