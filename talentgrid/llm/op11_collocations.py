"""Phrase collocations by SETM relational mining.

The mining runs level by level over occurrence relations.  A relation is sorted by document,
piece and position and persisted in chunks of about ``CHUNK_BYTES`` of text; a chunk holds, for
every position, the number of its phrase in the chunk, -1 where a piece ends or the phrase is not
frequent, and for each distinct phrase its key and its count there.  One level is

* group-count: the chunks' phrases are dealt by key, summed, and groups under the support go;
* semi-join: every chunk gets back which of its phrases are frequent;
* merge-join: in each chunk the frequent occurrences at adjacent positions of one piece, found by
  one pass over the sorted relation, are the occurrences of the next length.

A phrase of k words is keyed by its two frequent parts of k - 1 words (all but the last, all but
the first word), which have numbers of their own: a group's number is the least place (chunk,
number in the chunk) where its phrase occurs.  So keys are exact, no text is carried past the first
level, and a phrase that occurs ten million times is one entry in each chunk.

Every frequent phrase keeps the counts of all its beginnings and ends; these are the two sides of
each cut.  Scores are decimals of 38 digits: exact.

Defined results: a null text is empty and a null lang is ``und``; repeated rows count each; a
phrase never spans pieces or documents; ties are as stated at :func:`mine`; other columns are
ignored; an empty table gives an empty result.  A single text longer than a chunk is one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import words as W
from .common import discard, scratch_path, ship, table

SUPPORT, LONGEST, TOP, CONTAINED = 10, 3, 2000, 50
#: Text of a chunk, and of the slices in which a chunk is read; a chunk has under 2**PLACE phrases.
CHUNK_BYTES, SLICE_BYTES, PLACE = 16 << 20, 1 << 20, 28
#: Phrases of the chunks that one counting task takes, about.
ENTRIES = 1 << 20
#: Salts of the last ranking, each of which names its own first ``TOP`` phrases of a lang.
SALTS = 32

#: Bytes that end a piece, and white space inside one.
ENDS, SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"
IS_END = np.zeros(256, bool)
IS_END[list(ENDS)] = True
IN_WORD = ~IS_END
IN_WORD[list(SPACES)] = False

RELATION = "chunk long, places binary, part long, local array<int>, n array<int>, word array<string>, ga array<long>, gb array<long>"
COUNTED = "chunk long, local array<int>, g array<long>, word array<string>, ga array<long>, gb array<long>, f array<long>"


def _ints(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(np.ascontiguousarray(x)).cast(kind)


def _cut(values: pa.Array, at: np.ndarray) -> pa.ListArray:
    """One list per slice of ``values`` between the offsets ``at``."""
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)


def _blocks(chunk: int, places: np.ndarray | None, part: np.ndarray, parts: int, n: np.ndarray, word: pa.Array | None, ga: np.ndarray | None, gb: np.ndarray | None) -> pa.RecordBatch:
    """A chunk's rows: its relation, and its phrases (numbered by their order) dealt into parts."""
    order = np.argsort(part, kind="stable")
    at = np.searchsorted(part[order], np.arange(parts + 1))
    used = np.flatnonzero(np.diff(at))
    offsets = np.append(at[used], len(order))
    k = len(used)
    with_relation = lambda lists: pa.concat_arrays([pa.nulls(1, lists.type), lists])
    columns = [pa.array([chunk] * (k + 1), pa.int64()), pa.array([None if places is None else places.astype(np.int32).tobytes()] + [None] * k, pa.binary()), pa.concat_arrays([pa.nulls(1, pa.int64()), _ints(used, pa.int64())])]
    columns += [with_relation(_cut(_ints(order, pa.int32()), offsets)), with_relation(_cut(_ints(n[order], pa.int32()), offsets))]
    columns.append(pa.nulls(k + 1, pa.list_(pa.string())) if word is None else with_relation(_cut(word.take(pa.array(order)), offsets)))
    columns += [pa.nulls(k + 1, pa.list_(pa.int64())) if g is None else with_relation(_cut(_ints(g[order], pa.int64()), offsets)) for g in (ga, gb)]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in RELATION.split(", ")])


def _word_hash(words: pa.StringArray) -> np.ndarray:
    """A hash of each string, to deal words into parts."""
    raw, off = W.buffer_of(words)
    return W.hash_words(raw, off[:-1], off[1:]) if len(raw) else np.zeros(len(words), np.uint64)


def read_slice(raw: np.ndarray, off: np.ndarray, langs: list[str]) -> tuple[np.ndarray, pa.Array]:
    """Places of some texts (numbers of words in order, -1 at the end of a piece) and the distinct words, each as word, space, lang."""
    raw = W.LOWER[raw]
    starts, ends, first = W.spans(raw, off, IN_WORD)
    if not len(starts):
        return np.zeros(0, np.int64), pa.array([], pa.string())
    to = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(to.tobytes()), pa.py_buffer(raw[IN_WORD[raw]].tobytes())).dictionary_encode()
    kinds = sorted(set(langs))
    lang = np.repeat(np.array([kinds.index(x) for x in langs]), np.diff(first))
    code = words.indices.to_numpy().astype(np.int64) * len(kinds) + lang
    there = np.flatnonzero(np.bincount(code, minlength=len(words.dictionary) * len(kinds)))
    number = np.zeros(len(words.dictionary) * len(kinds), np.int64)
    number[there] = np.arange(len(there))
    names = words.dictionary.take(pa.array(there // len(kinds)))
    names = pc.binary_join_element_wise(names, pa.array(kinds, pa.string()).take(pa.array(there % len(kinds))), " ")
    # a place of its own for each end of a piece or text that lies before a word
    ended = np.concatenate(([0], np.cumsum(IS_END[raw])))[starts]
    new = np.ones(len(starts), bool)
    new[1:] = ended[1:] != ended[:-1]
    new[first[:-1][np.diff(first) > 0]] = True
    at = np.arange(len(starts)) + np.cumsum(new)
    places = np.full(at[-1] + 1, -1, np.int64)
    places[at] = number[code]
    return places, names


def occurrences(docs: DataFrame, parts: int, text: str = "text", lang: str = "lang") -> DataFrame:
    """The first relation: all words of all texts, with their counts in each chunk."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, 0
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 12

        def chunk() -> pa.RecordBatch:
            all_words = pa.concat_arrays([w for _, w in held]).dictionary_encode()
            index, places, at = all_words.indices.to_numpy(), [], 0
            for p, w in held:
                own = np.append(index[at : at + len(w)], -1)  # -1 stays -1
                places.append(own[p])
                at += len(w)
            places = np.concatenate(places)
            n = np.bincount(places[places >= 0], minlength=len(all_words.dictionary))
            part = (_word_hash(all_words.dictionary) % np.uint64(parts)).astype(np.int64)
            return _blocks(base + number, places, part, parts, n, all_words.dictionary, None, None)

        for part, raw, off in W.chunks(batches, "_text", SLICE_BYTES):
            places, names = read_slice(raw, off, part.column(1).to_pylist())
            if len(names):
                held.append((places, names))
            size += len(raw)
            if held and size >= CHUNK_BYTES:
                yield chunk()
                held, size, number = [], 0, number + 1
        if held:
            yield chunk()

    slim = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text"), F.coalesce(F.col(lang), F.lit("und")).alias("_lang"))
    return slim.mapInArrow(run, RELATION)


def _values(t: pa.Table, name: str) -> pa.Array:
    return t.column(name).combine_chunks().flatten()


def counter(level: int, support: int, last: bool):
    """Sums the entries of one part: frequent phrases, and for each chunk which of its phrases they are."""

    def run(t: pa.Table) -> pa.Table:
        per = np.diff(t.column("local").combine_chunks().offsets.to_numpy())
        chunk = np.repeat(t.column("chunk").to_numpy(), per)
        local, n = _values(t, "local").to_numpy().astype(np.int64), _values(t, "n").to_numpy().astype(np.int64)
        place = (chunk << PLACE) | local
        if level == 1:
            words = _values(t, "word").dictionary_encode()
            group = words.indices.to_numpy()
            order = np.argsort(group, kind="stable")
            first = np.searchsorted(group[order], np.arange(len(words.dictionary)))
        else:
            ga, gb = _values(t, "ga").to_numpy(), _values(t, "gb").to_numpy()
            order = np.lexsort((gb, ga))
            new = np.ones(len(order), bool)
            new[1:] = (ga[order][1:] != ga[order][:-1]) | (gb[order][1:] != gb[order][:-1])
            first = np.flatnonzero(new)
        f = np.add.reduceat(n[order], first)
        g = np.minimum.reduceat(place[order], first)
        ok = np.flatnonzero(f >= support)
        found = pa.table({
            "chunk": pa.nulls(1, pa.int64()),
            "local": pa.nulls(1, pa.list_(pa.int32())),
            "g": _cut(_ints(g[ok], pa.int64()), [0, len(ok)]),
            "word": _cut(words.dictionary.take(pa.array(ok)), [0, len(ok)]) if level == 1 else pa.nulls(1, pa.list_(pa.string())),
            "ga": pa.nulls(1, pa.list_(pa.int64())) if level == 1 else _cut(_ints(ga[order][first[ok]], pa.int64()), [0, len(ok)]),
            "gb": pa.nulls(1, pa.list_(pa.int64())) if level == 1 else _cut(_ints(gb[order][first[ok]], pa.int64()), [0, len(ok)]),
            "f": _cut(_ints(f[ok], pa.int64()), [0, len(ok)]),
        })
        if last:
            return found
        size = np.diff(np.append(first, len(order)))
        frequent = np.zeros(len(order), bool)
        frequent[order] = np.repeat(f >= support, size)
        number = np.empty(len(order), np.int64)
        number[order] = np.repeat(g, size)
        by = np.flatnonzero(frequent)
        by = by[np.argsort(chunk[by], kind="stable")]
        chunks, at = np.unique(chunk[by], return_index=True)
        at = np.append(at, len(by))
        semi = {"chunk": _ints(chunks, pa.int64()), "local": _cut(_ints(local[by], pa.int32()), at), "g": _cut(_ints(number[by], pa.int64()), at)}
        semi |= {c: pa.nulls(len(chunks), found.schema.field(c).type) for c in ("word", "ga", "gb", "f")}
        return pa.concat_tables([found, pa.table(semi)])

    return run


def extend(parts: int):
    """Joins a chunk's frequent occurrences at adjacent positions: the relation of the next length."""

    def run(relation: pa.Table, frequent: pa.Table) -> pa.Table:
        empty = pa.table({c: pa.array([], k) for c, k in zip([x.split()[0] for x in RELATION.split(", ")], (pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)})
        if not (relation.num_rows and frequent.num_rows):
            return empty
        places = np.frombuffer(relation.column("places")[0].as_py(), np.int32)
        local, g = _values(frequent, "local").to_numpy(), _values(frequent, "g").to_numpy()
        index = np.full(max(int(places.max(initial=-1)), int(local.max(initial=-1))) + 2, -1, np.int64)  # the last: of place -1
        index[local] = np.arange(len(local))
        own = index[places]
        both = np.flatnonzero((own[:-1] >= 0) & (own[1:] >= 0))
        if not len(both):
            return empty
        code, number, n = np.unique(own[both] * len(local) + own[both + 1], return_inverse=True, return_counts=True)
        joined = np.full(len(places), -1, np.int64)
        joined[both] = number
        ga, gb = g[code // len(local)], g[code % len(local)]
        key = W.mix(ga.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ W.mix(gb.view(np.uint64)))
        rows = _blocks(relation.column("chunk")[0].as_py(), joined, (key % np.uint64(parts)).astype(np.int64), parts, n, None, ga, gb)
        return pa.Table.from_batches([rows])

    return run


def _kept(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """Like ``written``, packed tighter and in small row groups: a row here is a large part of a chunk."""
    path = scratch_path(spark, tag)
    df.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._talentgrid_path = path
    return out


def frequent_phrases(docs: DataFrame, support: int, longest: int, text: str, lang: str) -> tuple[list[DataFrame], DataFrame, list[DataFrame]]:
    """Frequent phrases of each length, the number of words of each lang, and the tables they are read from."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()[0]
    relation = _kept(spark, occurrences(docs, max(tasks, size // (32 * ENTRIES)), text, lang), "occurrences-1")
    words = relation.filter("part is not null").select(F.explode(F.arrays_zip("word", "n")).alias("x"))
    totals = words.groupBy(F.expr("substr(x.word, instr(x.word, ' ') + 1)").alias("lang")).agg(F.sum("x.n").cast("long").alias("n"))
    totals = _kept(spark, totals, "lang-words")
    entries, levels = int(totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]), []
    parts = max(tasks, -(-entries // ENTRIES))
    for level in range(1, longest + 1):
        counted = relation.filter("part is not null").groupBy("part").applyInArrow(counter(level, support, level == longest), COUNTED)
        counted = _kept(spark, counted, f"counted-{level}")
        levels.append(counted)
        if level < longest:
            both = relation.filter("places is not null").select("chunk", "places").groupBy("chunk").cogroup(counted.filter("chunk is not null").select("chunk", "local", "g").groupBy("chunk"))
            longer = _kept(spark, both.applyInArrow(extend(parts), RELATION), f"occurrences-{level + 1}")
            discard(relation)
            relation = longer
    discard(relation)
    phrases = []
    for level, counted in enumerate(levels, 1):
        x = F.explode(F.arrays_zip("g", "word", "f") if level == 1 else F.arrays_zip("g", "ga", "gb", "f")).alias("x")
        phrases.append(counted.filter("chunk is null").select(x).select("x.*"))
    return phrases, totals, levels


def mine(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, top: int = TOP, contained: int = CONTAINED, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each lang.

    A phrase of two to ``longest`` words with a count of ``support`` or more is cut where
    floor(1000000 a a / (l r)) is least (ties: after fewest words).  A phrase is left out if a longer
    one that holds it has ``contained`` percent of its count or more.  Order: score and a descending,
    then the phrase by its bytes.
    """
    spark = docs.sparkSession
    levels, totals, _ = frequent_phrases(docs, support, longest, text, lang)
    space = F.instr("word", " ")
    known = levels[0].select("g", F.expr("substr(word, instr(word, ' ') + 1)").alias("lang"), F.expr("substr(word, 1, instr(word, ' ') - 1)").alias("phrase"), "f", F.array("f").alias("heads"), F.array("f").alias("tails"))
    out = None
    for length in range(2, longest + 1):
        # of a shorter phrase: its lang, text, and the counts of its beginnings and ends
        head = known.select(F.col("g").alias("ga"), "lang", F.col("phrase").alias("front"), "heads")
        tail = known.select(F.col("g").alias("gb"), F.element_at(F.split("phrase", " "), -1).alias("end"), "tails")
        grown = levels[length - 1].join(head, "ga").join(tail, "gb")
        grown = grown.select("g", "ga", "gb", "lang", F.concat_ws(" ", "front", "end").alias("phrase"), "f", F.concat("heads", F.array("f")).alias("heads"), F.concat("tails", F.array("f")).alias("tails"))
        grown = _kept(spark, grown, f"phrases-{length}")
        if out is not None:  # the phrases one word shorter, without those that live in a longer one
            longer = grown.select(F.explode(F.array("ga", "gb")).alias("g"), "f").groupBy("g").agg(F.max("f").alias("more"))
            out[-1] = out[-1].join(longer, "g", "left").filter(f"more is null or 100 * more < {contained} * f").drop("more")
        out = [*(out or []), grown]
        known = grown
    if out is None:
        raise ValueError("phrases have two words or more")
    found = out[0].select("lang", "phrase", "f", "heads", "tails")
    for more in out[1:]:
        found = found.unionByName(more.select("lang", "phrase", "f", "heads", "tails"))
    number = "cast({} as decimal(16,0))".format
    cut = f"{number('f')} * {number('f')} * 1000000 div ({number('heads[k - 1]')} * {number('tails[size(heads) - k - 1]')})"
    cuts = f"transform(sequence(1, size(heads) - 1), k -> struct(cast({cut} as bigint) as score, k as k, heads[k - 1] as l, tails[size(heads) - k - 1] as r))"
    found = found.select("lang", "phrase", F.col("f").alias("a"), F.array_min(F.expr(cuts)).alias("c"))
    key = F.struct((-F.col("c.score")).alias("down"), (-F.col("a")).alias("less"), "phrase", "a", "c.l", "c.r")
    found = found.select("lang", key.alias("key"), F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"))
    own = Window.partitionBy("lang", "salt").orderBy("key")
    first = found.withColumn("place", F.row_number().over(own)).filter(F.col("place") <= top)
    # SALTS * top rows of a lang at most
    first = first.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list("key")), 1, top).alias("keys"))
    ranked = first.join(totals, "lang").select("lang", "n", F.posexplode("keys").alias("at", "key"))
    return ranked.select("lang", (F.col("at") + 1).cast("long").alias("rank"), "key.phrase", "key.a", "key.l", "key.r", "n", (-F.col("key.down")).alias("score"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first collocations of every lang over all of ``documents``."""
    return mine(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """DuckDB SQL for the same rows: every phrase counted as a string."""
    return rf"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang,
         regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps
  FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(ps) AS p FROM t)),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda j: array_to_string(ws[j:j + k - 1], ' '))) AS phrase FROM w, (SELECT unnest(range(1, {LONGEST + 1})) AS k)),
f AS (SELECT lang, k, phrase, count(*) AS c FROM g GROUP BY ALL),
n AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, c AS a FROM f WHERE k > 1 AND c >= {SUPPORT}),
cuts AS (
  SELECT x.lang, x.phrase, x.a, first, l.c AS l, r.c AS r, (1000000::HUGEINT * a * a) // (l.c::HUGEINT * r.c) AS score
  FROM (SELECT *, unnest(range(1, k)) AS first FROM c) x
  JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.ws[1:x.first], ' ')
  JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.ws[x.first + 1:x.k], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, first) = 1),
parts AS (
  SELECT lang, a, array_to_string(ws[i:j], ' ') AS phrase
  FROM (SELECT *, unnest(range(i, k + 1)) AS j FROM (SELECT *, unnest(range(1, k + 1)) AS i FROM c)) WHERE j - i + 1 < k),
gone AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN parts ON parts.lang = c.lang AND parts.phrase = c.phrase WHERE 100 * parts.a >= {CONTAINED} * c.a),
left_ AS (SELECT * FROM best ANTI JOIN gone USING (lang, phrase)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= {TOP}
"""
