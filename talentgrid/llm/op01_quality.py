"""Quality rules: a threshold table compiled into one Spark projection.

All measures are DataFrame functions (no Python on the executors).  A :class:`Rule` names a
measure and its allowed range; :func:`compile_rules` turns the table into one boolean
expression, so the whole verdict is a single projection over the scan, without a shuffle.

Defined results: a null text counts as an empty text (no words, ``base_failed`` true); ties
and repeated rows get one result each; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The word, symbol and window definitions of the query.
SPLIT = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
NOT_SYMBOL = r"[^#*$%&|<>]+"
WINDOW = 8

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = {
    "en": "a an and are as at be by for from in is it of on or that the this to was were when with".split(),
    "de": "auf aus das dem den der des die ein eine einer für im in ist mit nicht sich sie und von zu".split(),
    "fr": "au aux avec dans de des du elle en est et la le les par pas pour que qui sur un une".split(),
    "es": "al como con de del el en es la las los no para por que se su un una y".split(),
}


@dataclass(frozen=True)
class Rule:
    """Keep a text only if ``low <= measure <= high``."""

    measure: str
    low: float
    high: float


#: The production thresholds.
RULES = (
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbols_per_word", 0.0, 0.10),
    Rule("bangs_per_word", 0.0, 0.10),
    Rule("stop_word_ratio", 0.06, 1.0),
    Rule("dup_line_ratio", 0.0, 0.50),
    Rule("stutter_ratio", 0.0, 0.20),
    Rule("upper_ratio", 0.0, 0.30),
)


def compile_rules(rules: tuple[Rule, ...], measures: dict[str, Column]) -> Column:
    """One conjunction over the table's rows; a null measure fails its rule."""
    verdict = F.lit(True)
    for r in rules:
        m = measures[r.measure]
        verdict = verdict & F.coalesce(m.between(F.lit(r.low), F.lit(r.high)), F.lit(False))
    return verdict


def _bind(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it many times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words covered by 8-word windows that occur twice or more in the text."""
    n = F.size(words)

    def covered(pairs: Column) -> Column:
        # pairs: (hash, start) in order; a start is repeated if a neighbour has its hash
        def flag(p: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(pairs, i - 1)["h"] == p["h"]).otherwise(F.lit(False))
            return before | F.coalesce(F.get(pairs, i + 1)["h"] == p["h"], F.lit(False))

        starts = F.array_sort(F.transform(F.filter(pairs, flag), lambda p: p["i"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

        def step(acc: Column, s: Column) -> Column:
            return F.struct(
                (acc["n"] + F.lit(WINDOW) - F.greatest(F.lit(0), acc["end"] - s)).alias("n"),
                (s + F.lit(WINDOW)).alias("end"),
            )

        return F.aggregate(starts, zero, step, lambda acc: acc["n"])

    def repeated(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_bind(pairs, covered))

    windows = F.transform(F.sequence(F.lit(1), n - F.lit(WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(n > WINDOW, _bind(windows, repeated)).otherwise(F.lit(0)).cast("long")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with counts in columns ``_q_*``.

    Each count is a column of its own, used more than once above: the optimizer then keeps
    this projection apart and evaluates every count once per row.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    stop = sorted({w for ws in STOP_WORDS.values() for w in ws})
    words, n = F.col("_q_words"), F.size("_q_words")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    return (
        docs.withColumns({"_q_words": F.array_remove(F.split(t, SPLIT), ""), "_q_lines": lines})
        .withColumns(
            {
                "_q_n_words": n.cast("long"),
                "_q_word_chars": F.length(F.array_join(words, "")).cast("long"),
                "_q_n_symbols": F.length(F.regexp_replace(t, NOT_SYMBOL, "")).cast("long"),
                "_q_n_lines": F.size("_q_lines"),
                "_q_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
                "_q_repeat_words": _repeat_words(words),
                "_q_n_bangs": F.length(F.regexp_replace(t, "[^!]+", "")),
                "_q_n_stop": F.size(F.filter(words, lambda w: w.isin(stop))),
                "_q_n_stutter": F.size(F.filter(words, lambda w, i: (i > 0) & (F.get(words, i - 1) == w))),
                "_q_n_upper": F.length(F.regexp_replace(t, r"\P{Lu}+", "")),
            }
        )
        .drop("_q_words", "_q_lines")
    )


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with its counts, ``base_failed`` and ``kept``.

    ``base_failed``: under 20 words, or over 30 % of the words in repeated 8-word windows.
    ``kept``: not failed there, and inside every range of the threshold table.
    """
    n = F.col("_q_n_words")
    ratio = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y))
    measures = {
        "mean_word_chars": ratio("_q_word_chars", "_q_n_words"),
        "symbols_per_word": ratio("_q_n_symbols", "_q_n_words"),
        "bangs_per_word": ratio("_q_n_bangs", "_q_n_words"),
        "stop_word_ratio": ratio("_q_n_stop", "_q_n_words"),
        "dup_line_ratio": ratio("_q_dup_lines", "_q_n_lines"),
        "stutter_ratio": ratio("_q_n_stutter", "_q_n_words"),
        "upper_ratio": ratio("_q_n_upper", "_q_word_chars"),
    }
    failed = (n < 20) | (100 * F.col("_q_repeat_words") > 30 * n)
    out = measure(docs, text).withColumns({"_v_failed": failed, "_v_passed": compile_rules(rules, measures)})
    return out.withColumns(
        {
            "n_words": n,
            "word_chars": F.col("_q_word_chars"),
            "n_symbols": F.col("_q_n_symbols"),
            "n_dup_lines": F.col("_q_dup_lines"),
            "n_repeat_words": F.col("_q_repeat_words"),
            "base_failed": F.col("_v_failed"),
            "kept": ~F.col("_v_failed") & F.col("_v_passed"),
        }
    ).drop("_v_failed", "_v_passed", "_q_n_words", "_q_word_chars", "_q_n_symbols", "_q_n_lines", "_q_dup_lines", "_q_repeat_words", "_q_n_bangs", "_q_n_stop", "_q_n_stutter", "_q_n_upper")


def keep_passing(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that every rule keeps, with their own columns.

    The verdict passes through a generator before the filter: a filter on it directly would be
    pushed below the projections, and every count would be evaluated again for each of its
    uses there.
    """
    out = quality(docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_body")), rules, "_body")
    return out.select("_row", F.explode(F.array("kept")).alias("_kept")).filter("_kept").select("_row.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table with its quality counts and verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle() -> str:
    """DuckDB SQL for the same rows: the same definitions, written independently."""
    stop = ", ".join("'" + w + "'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM t),
win AS (
  SELECT doc_id, ord, array_to_string(ws[ord:ord + 7], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS ord FROM w WHERE len(ws) >= 8)),
rep AS (SELECT doc_id, g FROM win GROUP BY ALL HAVING count(*) > 1),
cov AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT win.doc_id, unnest(range(ord, ord + 8)) AS p FROM win JOIN rep USING (doc_id, g)) GROUP BY 1),
m AS (
  SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(cov.n, 0) AS n_repeat_words,
         length(regexp_replace(text, '[^!]', '', 'g')) AS bangs,
         len(list_filter(ws, lambda x: x IN ({stop}))) AS stops,
         len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS stutter,
         length(regexp_replace(text, '\P{{Lu}}', '', 'g')) AS upper
  FROM w LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 2 AND 14 AND n_symbols / n_words <= 0.1
       AND bangs / n_words <= 0.1 AND stops / n_words >= 0.06 AND n_dup_lines / n_lines <= 0.5
       AND stutter / n_words <= 0.2 AND upper / word_chars <= 0.3 AS kept
FROM b
"""
