"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a column expression over one document (no user function, no
shuffle): lengths, symbols, stop words, repeated lines and repeated three-word
windows.  ``RULES`` is the threshold table; :func:`verdict` turns it into one
boolean expression.

Cases: a NULL text has no words and is rejected like an empty one; a document
whose ``doc_id`` is NULL is judged like any other; repeated rows are judged
each by itself; an empty table gives an empty result; other columns pass
through untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import computed, let, packed, unpacked, words

SYMBOLS = r"[#*$%&|<>]"

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = ("the", "and", "of", "to", "in", "a", "is", "that", "it", "for", "was", "with", "by", "on", "as",
              "be", "are", "at", "this", "from", "or", "an",
              "le", "la", "les", "de", "des", "du", "un", "une", "et", "en", "que", "qui", "dans", "pour", "par",
              "sur", "au", "il", "elle", "ce",
              "der", "die", "das", "und", "von", "zu", "den", "mit", "ist", "ein", "eine", "auf", "für", "nicht",
              "sich", "auch", "im", "dem", "es",
              "el", "los", "las", "y", "del", "se", "una", "con", "no", "su", "para", "como", "más", "o", "al", "lo")

#: Threshold table: (rule, measure, per, least, most).  A rule holds if
#: ``least * per <= measure <= most * per``; ``per`` "1" is a plain count.
#: All numbers are whole hundredths, so no rounding decides.
RULES: tuple[tuple[str, str, str, int | None, int | None], ...] = (
    ("word_length", "word_chars", "n_words", 250, 1200),      # mean word length 2.5 to 12
    ("symbols", "n_symbols", "n_words", None, 25),            # at most a quarter of a symbol a word
    ("stop_words", "n_stop_words", "1", 200, None),           # at least two stop words
    ("capitals", "n_upper_words", "n_words", None, 50),       # at most half the words in capitals
    ("dup_lines", "n_dup_lines", "n_lines", None, 50),        # at most half the lines repeat an earlier one
    ("bullets", "n_bullet_lines", "n_lines", None, 90),
    ("ellipses", "n_ellipsis_lines", "n_lines", None, 30),
)

MIN_WORDS = 50
MAX_REPEAT_PCT = 50

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words",
            "n_upper_words", "n_lines", "n_bullet_lines", "n_ellipsis_lines")


def repeat_words(w: Column) -> Column:
    """Words that lie in a three-word window which the text has twice or more.

    The windows are sorted with their positions; equal neighbours give the
    positions of repeated windows; each covers three words, less what the
    next one covers too.
    """
    def covered(starts):
        step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"),
                                       p.alias("last"))
        return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), step)["n"]

    def repeated(s):
        like = lambda x, i: F.coalesce(x["w"] == F.get(s, i)["w"], F.lit(False))
        hit = F.filter(s, lambda x, i: like(x, i - 1) | like(x, i + 1))
        return covered(F.array_sort(F.transform(hit, lambda x: x["p"])))

    starts = F.sequence(F.lit(0), F.size(w) - 3)
    windows = F.transform(starts, lambda i: F.struct(
        F.concat_ws(" ", w[i], w[i + 1], w[i + 2]).alias("w"), i.cast("int").alias("p")))
    return F.when(F.size(w) >= 4, let(F.sort_array(windows), repeated)).otherwise(F.lit(0))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measures of every whole text as extra columns (a
    measure replaces a column of its name)."""
    t = F.coalesce(F.col(text), F.lit(""))
    has_word = lambda s: s.rlike(r"[^\x20\x09-\x0D]")
    lines = F.filter(F.split(t, "\n"), has_word)
    keep = [c for c in docs.columns if c.lower() not in MEASURES]
    d = docs.select(*keep, words(F.col(text)).alias("_w"), lines.alias("_l"), t.alias("_t"))
    capital = lambda x: (F.length(x) > 1) & (x == F.upper(x)) & (x != F.lower(x))
    w, ln = F.col("_w"), F.col("_l")
    return computed(
        d, keep,
        n_words=F.size(w).cast("long"),
        word_chars=F.length(F.array_join(w, "")).cast("long"),
        n_symbols=F.regexp_count(F.col("_t"), F.lit(SYMBOLS)).cast("long"),
        n_dup_lines=(F.size(ln) - F.size(F.array_distinct(ln))).cast("long"),
        n_repeat_words=repeat_words(w).cast("long"),
        n_stop_words=F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long"),
        n_upper_words=F.size(F.filter(w, capital)).cast("long"),
        n_lines=F.size(ln).cast("long"),
        n_bullet_lines=F.size(F.filter(ln, lambda s: s.rlike(r"^[\x20\x09-\x0D]*[-*•]"))).cast("long"),
        n_ellipsis_lines=F.size(F.filter(ln, lambda s: s.rlike(r"(?:\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("long"))


def verdict(rules: Sequence = RULES) -> Column:
    """The threshold table as one boolean expression."""
    ok = F.lit(True)
    for _, measure, per, least, most in rules:
        scale = F.lit(1) if per == "1" else F.col(per)
        value = F.lit(100) * F.col(measure)
        if least is not None:
            ok = ok & (value >= F.lit(least) * scale)
        if most is not None:
            ok = ok & (value <= F.lit(most) * scale)
    return ok


def base_failed() -> Column:
    return ((F.col("n_words") < MIN_WORDS)
            | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PCT) * F.col("n_words")))


def judge(docs: DataFrame, text: str = "text", rules: Sequence = RULES) -> DataFrame:
    """``docs`` with its measures, ``base_failed`` and ``kept``."""
    m = measures(docs.drop("base_failed", "kept"), text)
    return m.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep(docs: DataFrame, text: str = "text", rules: Sequence = RULES) -> DataFrame:
    """The documents the rules keep, with their own columns only.

    The measures are made beside the documents' columns, under names that no
    column has, so nothing of the input is replaced."""
    return unpacked(judge(packed(docs, _text=F.col(text)), "_text", rules).where("kept"), docs.columns)


def oracle_sql() -> str:
    """The same measures and rules in DuckDB."""
    sp, stop = r"[\x20\x09-\x0D]", "|".join(STOP_WORDS)
    conds = []
    for _, measure, per, least, most in RULES:
        scale = "1" if per == "1" else per
        if least is not None:
            conds.append(f"100 * {measure} >= {least} * {scale}")
        if most is not None:
            conds.append(f"100 * {measure} <= {most} * {scale}")
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\\x20\\x09-\\x0D]')) AS ls FROM t),
win AS (SELECT rid, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS k
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i+1, i+2]) AS p FROM rep) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
       CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
       CAST(len(regexp_extract_all(text, '{SYMBOLS}')) AS BIGINT) AS n_symbols,
       CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
       CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
       CAST(len(list_filter(ws, lambda x: regexp_full_match(lower(x), '{stop}'))) AS BIGINT) AS n_stop_words,
       CAST(len(list_filter(ws, lambda x: length(x) > 1 AND x = upper(x) AND x <> lower(x))) AS BIGINT) AS n_upper_words,
       CAST(len(ls) AS BIGINT) AS n_lines,
       CAST(len(list_filter(ls, lambda s: regexp_matches(s, '^{sp}*[-*•]'))) AS BIGINT) AS n_bullet_lines,
       CAST(len(list_filter(ls, lambda s: regexp_matches(s, '(?:\\.\\.\\.|…){sp}*$'))) AS BIGINT) AS n_ellipsis_lines
      FROM w LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {' AND '.join(conds)} AS kept FROM b"""
