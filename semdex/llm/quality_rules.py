"""Heuristic quality rules compiled from a threshold table into one Spark projection, without user functions.

Words are maximal runs of characters other than ASCII white space. Counts are exact over the whole text. Repetition is
found per row with sorted arrays of 64-bit hashes of five-word windows, so a long text costs n log n, not n squared.

Defined cases: null text counts as empty; an empty or blank text has zero counts, fails the base rule (fewer than ten
words) and is not kept; repeated rows are judged alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semdex.llm.common import words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Common function words of the four languages (lower case, trailing full stop or comma removed before the test).
STOP_WORDS = (
    "a an and are as at be by for from have in is it of on or that the this to was with "
    "au dans de des du elle en est et il la le les pour que qui sur un une "
    "auf das dem den der des die ein eine für im in ist mit nicht sich und von zu "
    "al como con de del el en es la las lo los para por que se su un una y"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a document only if low <= metric <= high; metric is a Spark SQL expression over the counts."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None

    def passes(self) -> Column:
        value = F.expr(self.metric)
        ok = F.lit(True)
        if self.low is not None:
            ok = ok & (value >= self.low)
        if self.high is not None:
            ok = ok & (value <= self.high)
        return F.coalesce(ok, F.lit(False))

    def sql(self) -> str:
        parts = [f"({self.metric}) >= {self.low}"] * (self.low is not None) + [f"({self.metric}) <= {self.high}"] * (self.high is not None)
        return "(" + " AND ".join(parts) + ")"


#: Ratios are per word or per line; every metric is defined once there is a word. Under 50 words a share of stop words says
#: little, and a fixed one that passes stands for it.
RULES = (
    Rule("mean_word_length", "word_chars / greatest(n_words, 1)", 2.0, 14.0),
    Rule("symbols_per_word", "n_symbols / greatest(n_words, 1)", None, 0.1),
    Rule("stop_word_share", "CASE WHEN n_words < 50 THEN 0.4 ELSE n_stop / n_words END", 0.02, 0.8),
    Rule("duplicate_line_share", "n_dup_lines / greatest(n_lines, 1)", None, 0.5),
    Rule("bullet_line_share", "n_bullets / greatest(n_lines, 1)", None, 0.9),
)


def let(value: str, name: str, body: str) -> str:
    """Bind a SQL expression to a lambda variable, so that it is computed once a row wherever the optimizer moves the body."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


#: Words at positions that a five-word window found twice or more covers; `words` is the column of words.
_GRAMS = (
    f"CASE WHEN size(ws) >= {WINDOW} THEN sort_array(transform(sequence(0, size(ws) - {WINDOW}), i -> named_struct('h', xxhash64("
    + ", ".join(f"ws[i + {k}]" for k in range(WINDOW))
    + "), 'i', i))) ELSE array() END"
)
_TWICE = (
    "sort_array(transform(filter(transform(g, (x, k) -> named_struct('i', x.i, 'twice', "
    "(k > 0 AND get(g, k - 1).h = x.h) OR coalesce(get(g, k + 1).h = x.h, false))), x -> x.twice), x -> x.i))"
)
_COVERED = f"aggregate(transform(p, (x, k) -> least({WINDOW}, coalesce(get(p, k + 1) - x, {WINDOW}))), 0L, (a, x) -> a + x)"
REPEAT_WORDS = let("words", "ws", let(_GRAMS, "g", let(_TWICE, "p", _COVERED)))


def counted(docs: DataFrame) -> DataFrame:
    """doc_id and the counts every rule is made of."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        "text",
        words_of(F.col("text")).alias("words"),
        F.expr(r"filter(split(text, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')").alias("lines"),
    )
    return base.select(
        "doc_id",
        F.size("words").cast("bigint").alias("n_words"),
        F.char_length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("bigint").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.expr(REPEAT_WORDS).alias("n_repeat_words"),
        F.size(F.filter("words", lambda w: F.lower(F.rtrim(w, F.lit(".,"))).isin(STOP_WORDS))).cast("bigint").alias("n_stop"),
        F.size("lines").cast("bigint").alias("n_lines"),
        F.size(F.filter("lines", lambda s: s.rlike(r"^[\x20\x09]*[-*•]"))).cast("bigint").alias("n_bullets"),
    )


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The counts, base_failed, kept and the names of the rules a document breaks."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    verdict = F.lit(True)
    for r in rules:
        verdict = verdict & r.passes()
    broken = F.array_compact(F.array(*[F.when(~r.passes(), F.lit(r.name)) for r in rules]))
    return counted(docs).withColumns({"base_failed": failed, "kept": ~failed & verdict, "broken": broken})


def op5(docs: DataFrame) -> DataFrame:
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    stops = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    verdict = " AND ".join(r.sql() for r in rules)
    return rf"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), g AS (
  SELECT rid, i, words[i:i + 4] AS gram FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1
), cover AS (
  SELECT rid, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n_repeat_words
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM twice) GROUP BY rid
), c AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(list_filter(words, lambda x: lower(rtrim(x, '.,')) IN ({stops})))::BIGINT AS n_stop,
         len(lines)::BIGINT AS n_lines,
         len(list_filter(lines, lambda l: regexp_matches(l, '^[\x20\x09]*[-*\x{{2022}}]')))::BIGINT AS n_bullets
  FROM w LEFT JOIN cover USING (rid)
), b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND {verdict}) AS kept
FROM b"""
