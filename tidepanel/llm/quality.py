"""Line-first quality rules. Lines that fail a rule go; a document that loses too much text is rejected.

Built-in functions only: a document's words, lines and word windows are arrays of its own row, nothing is shuffled.
"""

from functools import reduce
from operator import or_

from pyspark.sql import functions as F

from tidepanel.llm.common import SPACE_CLASS, table, text_or_empty

#: Share of its characters that a document must keep.
LEAST_KEPT = 0.5
#: A line of at least this many words must hold a mark that ends or parts a sentence.
LONG_LINE = 12
#: Phrases of page furniture, matched without case.
BOILERPLATE = (
    "all rights reserved",
    "privacy policy",
    "terms of use",
    "terms of service",
    "cookie policy",
    "uses cookies",
    "accept cookies",
    "enable javascript",
    "javascript is disabled",
    "lorem ipsum",
    "click here",
    "read more",
    "sign up",
    "log in",
    "subscribe to our newsletter",
    "follow us on",
    "share this",
    "back to top",
    "skip to content",
)
_MARK = r"[.!?:;…。！？]"


def let(value, body):
    """``body`` of ``value``, which is evaluated once. A plain reference inside a lambda may be replaced by what it stands for, as
    when a filter moves below a projection, and would then be evaluated for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def count_of(column, chars):
    """Characters of ``column`` that are in the regex class ``chars``."""
    return F.length(column) - F.length(F.regexp_replace(column, chars, ""))


def has_marks(text):
    """Whether a text holds any character that the navigation, symbol and shouting rules count."""
    return reduce(or_, (text.contains(c) for c in ("!!", *"|»›·•"))) | text.rlike("[#*$%&<>]")


def has_boilerplate(text):
    lower = F.lower(text)
    return reduce(or_, (lower.contains(phrase) for phrase in BOILERPLATE))


def unmarked(line):
    """The punctuation rule: a long line without any mark that ends or parts a sentence."""
    words = F.length(F.trim(line)) - F.length(F.replace(line, F.lit(" "))) + 1
    return (words >= LONG_LINE) & ~line.rlike(_MARK)


def line_fails(line):
    """The rules of one line: navigation, symbols, shouting, boilerplate, and punctuation.

    Thresholds are shares of the line's words or characters, so a line is judged alike whatever its length.
    """
    words = F.length(F.trim(line)) - F.length(F.replace(line, F.lit(" "))) + 1
    separators, symbols = count_of(line, "[|»›·•]+"), count_of(line, "[#*$%&<>]+")
    shouts = F.length(line) - F.length(F.replace(line, F.lit("!")))
    navigation = (separators >= 2) & (separators * 4 >= words)
    symbolic = (symbols >= 2) & (symbols * 12 >= F.length(line))
    shouting = (shouts >= 2) & (shouts * 3 >= words)
    return navigation | symbolic | shouting | has_boilerplate(line) | unmarked(line)


def line_quality(docs, id_column="doc_id", text_column="text", least_kept=LEAST_KEPT, keep=()):
    """Per row: ``id_column``, the columns named in ``keep``, the counts of the text, base_failed, kept, clean_text and
    kept_share.

    Words are ``[^\\x20\\x09-\\x0D]+``; lines are parted by ``\\n``; lines without a word never fail. Null and empty texts have no
    words: all counts are 0, base_failed is true, kept is false. Repeated rows each give a row. Columns not named are not carried.
    """
    d = docs.select(F.col(id_column), *keep, text_or_empty(text_column).alias("__text"))
    text = F.col("__text")
    d = d.select(
        "*",
        F.array_remove(F.split(text, SPACE_CLASS), "").alias("__words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"),
    )
    words, lines = F.col("__words"), F.col("__lines")
    n = F.size(words)
    at_most = lambda ws: F.slice(ws, 1, F.greatest(F.size(ws) - 2, F.lit(0)))
    hashes = let(words, lambda ws: F.transform(at_most(ws), lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2))))
    triples = let(words, lambda ws: F.transform(at_most(ws), lambda w, i: F.concat_ws(" ", w, F.get(ws, i + 1), F.get(ws, i + 2))))
    d = d.select(
        id_column,
        *keep,
        F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x) + 1).alias("__chars"),
        n.cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        count_of(text, r"[#*$%&|<>]+").cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        # equal windows have equal hashes, so a text whose hashes all differ repeats none; the others compare the windows themselves
        F.when(let(hashes, lambda h: F.size(h) > F.size(F.array_distinct(h))), triples).alias("__windows"),
        # a text without any such mark or phrase can only fail the punctuation rule
        F.array_join(F.when(has_marks(text) | has_boilerplate(text), F.filter(lines, lambda x: ~line_fails(x))).otherwise(F.filter(lines, lambda x: ~unmarked(x))), "\n").alias("clean_text"),
    )
    windows = F.col("__windows")
    # sorted windows: equal neighbours are repeated ones
    numbered = F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    same = lambda s, k, x: F.coalesce(F.get(s, k)["w"] == x["w"], F.lit(False))
    repeated = let(F.sort_array(numbered), lambda s: F.filter(s, lambda x, k: same(s, k - 1, x) | same(s, k + 1, x)))
    # a window at i covers i, i + 1 and i + 2, less what the next repeated window covers
    covered = let(
        F.sort_array(F.transform(repeated, lambda x: x["i"])),
        lambda at: F.aggregate(
            F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))), F.lit(0), lambda x, y: x + y
        ),
    )
    covered = F.when(windows.isNotNull(), covered)
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    share = F.when(F.col("__chars") > 0, (F.length("clean_text") + 1) / F.col("__chars")).otherwise(F.lit(0.0))
    return d.select(
        id_column,
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base.alias("base_failed"),
        (~base & (share >= least_kept)).alias("kept"),
        "clean_text",
        share.alias("kept_share"),
    )


def op1_line_quality(spark, sf_dir):
    return line_quality(table(spark, sf_dir, "documents")).drop("clean_text", "kept_share")


_PHRASES = ", ".join(f"'{p}'" for p in BOILERPLATE)
_UNMARKED = rf"(length(trim(l, ' ')) - length(replace(l, ' ', '')) + 1 >= {LONG_LINE} AND NOT regexp_matches(l, '{_MARK}'))"
STATEMENT = rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
         w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[ 	-
]+'), lambda x : x <> '') AS words,
                      list_filter(string_split(text, chr(10)), lambda x : regexp_matches(x, '[^ 	-
]')) AS lines FROM d),
         t AS (SELECT doc_id, u.i AS i, words[u.i] || ' ' || words[u.i + 1] || ' ' || words[u.i + 2] AS triple
               FROM w, LATERAL (SELECT unnest(range(1, len(words) - 1)) AS i) AS u),
         r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, triple) AS n FROM t),
         c AS (SELECT doc_id, sum(least(3, coalesce(next - i, 3))) AS n
               FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM r WHERE n > 1) AS x GROUP BY doc_id),
         s AS (SELECT doc_id, l, length(l) - length(regexp_replace(l, '[|»›·•]', '', 'g')) AS seps,
                      length(l) - length(regexp_replace(l, '[#*$%&<>]', '', 'g')) AS syms, length(l) - length(replace(l, '!', '')) AS shouts,
                      length(trim(l, ' ')) - length(replace(l, ' ', '')) + 1 AS words
               FROM (SELECT doc_id, unnest(lines) AS l FROM w) AS x),
         k AS (SELECT doc_id, sum(length(l) + 1) AS whole,
                      sum(CASE WHEN (seps >= 2 AND seps * 4 >= words) OR (syms >= 2 AND syms * 12 >= length(l)) OR (shouts >= 2 AND shouts * 3 >= words)
                          OR list_bool_or(list_transform([{_PHRASES}], lambda p : contains(lower(l), p))) OR {_UNMARKED} THEN 0 ELSE length(l) + 1 END) AS good
               FROM s GROUP BY doc_id),
         b AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[ 	-
]+', '', 'g')) AS BIGINT) AS word_chars,
                      CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                      CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
                      greatest(k.good, 1) / k.whole AS share
               FROM w LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
           NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(share >= {LEAST_KEPT}, false) AS kept
    FROM b"""
