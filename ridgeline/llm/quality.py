"""Quality rules: a threshold table compiled into one Spark projection.

Everything is built-in Spark functions, so the rules run inside the scan's stage
with no shuffle and no Python.  ``THRESHOLDS`` lists, for each measured ratio,
the band in which a document is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BREAKS = " \t\n\x0b\x0c\r"  # what parts words; the SQL twin has them as a class
SYMBOLS = "#*$%&|<>"
LONGEST_REPEAT_PERCENT = 50
LEAST_WORDS = 50

# The commonest function words of four languages (fixed values).
STOP_WORDS = (
    "the of and to in is that it for was with as on be at by this are or from an "
    "der die das und ist von zu mit den im auf nicht ein eine sich des dem für "
    "le la les de des et en un une du que qui dans pour sur pas est au "
    "el los las y del se por con para una su al es lo como más"
).split()

# ratio, least and greatest kept value (None: unbounded)
THRESHOLDS: tuple[tuple[str, float | None, float | None], ...] = (
    ("n_words", 50, 1_000_000),
    ("mean_word_chars", 2.0, 14.0),
    ("symbols_per_word", None, 0.25),
    ("stop_word_ratio", 0.05, None),
    ("dup_line_ratio", None, 0.4),
    ("bullet_line_ratio", None, 0.9),
    ("ellipsis_line_ratio", None, 0.3),
)


def _words(text: Column) -> Column:
    """The words in order; breaks become plain spaces first, so that splitting needs no regular expression."""
    for c in BREAKS[1:]:
        text = F.replace(text, F.lit(c), F.lit(BREAKS[0]))
    return F.array_remove(F.split(text, BREAKS[0]), "")


def _symbols(text: Column) -> Column:
    """How many of ``SYMBOLS``, which take one byte each, are in the text."""
    rest = text
    for c in SYMBOLS:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return F.octet_length(text) - F.octet_length(rest)


def measured(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """The base counts, each column computed once: words, lines and windows stay arrays of the row."""
    kept = [F.col(c).alias(f"_k{i}") for i, c in enumerate(carry)]
    t = docs.select(F.col(id_col).alias("_id"), *kept, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
    kept = [f"_k{i}" for i in range(len(carry))]
    w = t.select("_id", *kept, "_t", _words(F.col("_t")).alias("_w"), F.split("_t", "\n").alias("_l"))
    counted = w.select(
        "_id", *kept,
        F.size("_w").alias("n_words"),
        F.length(F.array_join("_w", "")).alias("word_chars"),
        _symbols(F.col("_t")).alias("n_symbols"),
        # a line counts as repeated if it has a word and an equal line stands before it
        F.filter("_l", lambda x: F.ltrim(x, F.lit(BREAKS)) != "").alias("_l"),
        # a window's hash over its three words in order; windows start at words 0 to n - 3
        F.transform(F.slice("_w", 1, F.greatest(F.size("_w") - 2, F.lit(0))), lambda a, i: F.xxhash64(a, F.get("_w", i + 1), F.get("_w", i + 2))).alias("_h"),
        # the length, which lower-casing to a stop word keeps, spares most words the rest
        F.size(F.filter("_w", lambda x: (F.length(x) <= max(map(len, STOP_WORDS))) & F.lower(x).isin(STOP_WORDS))).alias("_stop"),
    )
    # windows in the order of (hash, place); texts without an equal pair, the usual case, skip the sort
    tagged = F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    ordered = counted.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), tagged)).drop("_h")
    return ordered.select(
        "_id", *kept, "n_words", "word_chars", "n_symbols", "_stop",
        F.size("_l").alias("_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).alias("n_dup_lines"),
        F.size(F.filter("_l", lambda x: F.ltrim(x).rlike(r"^[-*•]"))).alias("_bullets"),
        F.size(F.filter("_l", lambda x: F.rtrim(x).rlike(r"(\.\.\.|…)$"))).alias("_ellipses"),
        _covered(F.col("_s")).alias("n_repeat_words"),
    )


def _covered(tagged: Column) -> Column:
    """How many words lie in a window whose hash occurs twice or more, from windows ordered by (hash, place).

    A window is repeated if a neighbour has its hash; the words at places p, p+1
    and p+2 of repeated windows are counted once each.
    """
    edge = F.array(F.struct(F.lit(None).cast("bigint").alias("h"), F.lit(-1).alias("i")))
    last = F.size(tagged) - 1
    same_as_before = F.zip_with(F.concat(edge, F.slice(tagged, 1, last)), tagged, lambda a, b: a["h"] == b["h"])
    same_as_next = F.zip_with(F.concat(F.slice(tagged, 2, last), edge), tagged, lambda c, b: F.when(c["h"] == b["h"], b["i"]))
    places = F.zip_with(F.zip_with(same_as_before, tagged, lambda s, b: F.when(s, b["i"])), same_as_next, lambda a, b: F.coalesce(a, b))
    words = F.flatten(F.transform(F.filter(places, lambda i: i.isNotNull()), lambda i: F.array(i, i + 1, i + 2)))
    return F.when(tagged.isNull(), F.lit(0)).otherwise(F.size(F.array_distinct(words)))


def ratios() -> dict[str, Column]:
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("_lines"), F.lit(1))
    return {
        "n_words": F.col("n_words"),
        "mean_word_chars": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "stop_word_ratio": F.col("_stop") / words,
        "dup_line_ratio": F.col("n_dup_lines") / lines,
        "bullet_line_ratio": F.col("_bullets") / lines,
        "ellipsis_line_ratio": F.col("_ellipses") / lines,
    }


def compiled(thresholds=THRESHOLDS) -> Column:
    """The threshold table as one boolean expression."""
    ok = F.lit(True)
    known = ratios()
    for name, least, most in thresholds:
        if least is not None:
            ok = ok & (known[name] >= least)
        if most is not None:
            ok = ok & (known[name] <= most)
    return ok


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", thresholds=THRESHOLDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(<id_col>, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ...ratios)``.

    A row for a row.  A null text has no words and fails; so does an empty one.
    Ids may be null or repeated; an empty table gives an empty result; other
    columns are ignored, but for those named in ``carry``, which come along.
    """
    m = measured(docs, id_col, text_col, carry)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words").cast("long") > LONGEST_REPEAT_PERCENT * F.col("n_words"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    shown = [(c.cast("double")).alias(k) for k, c in ratios().items() if k != "n_words"]
    return m.select(
        *([] if id_col in carry else [F.col("_id").alias(id_col)]), *[F.col(f"_k{i}").alias(c) for i, c in enumerate(carry)],
        *[F.col(c).cast("long").alias(c) for c in counts],
        failed.alias("base_failed"), (~failed & compiled(thresholds)).alias("kept"), *shown,
    )


def passing(docs: DataFrame, columns: tuple[str, ...], text_col: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """The rows that the table keeps, with ``columns``; no shuffle.  Null and empty texts go.

    The row number in the projection is a barrier: a filter isn't moved below a
    projection with an expression that isn't deterministic, so the measures stay
    computed once instead of being copied into the filter wherever it uses them.
    """
    scored = score(docs, text_col, text_col, thresholds, carry=columns)
    held = scored.withColumn("_barrier", F.monotonically_increasing_id())
    return held.filter("kept AND _barrier >= 0").select(*columns)


def oracle_sql(thresholds=THRESHOLDS) -> str:
    """The same rows in DuckDB's SQL, over ``documents``."""
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    rules = " AND ".join(f"{name} {sign} {v}" for name, lo, hi in thresholds for sign, v in ((">=", lo), ("<=", hi)) if v is not None)
    brk = r"[\x20\x09-\x0D]+"
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, list_filter(regexp_split_to_array(t, '{brk}'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: length(regexp_replace(x, '{brk}', '', 'g')) > 0) AS l
  FROM t
),
h AS (SELECT doc_id, t, w, l, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS h FROM w),
x AS (SELECT doc_id, unnest(h) AS g, unnest(range(0, len(h))) AS i FROM h),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM x) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
m AS (
  SELECT h.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{brk}', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         len(list_filter(w, lambda y: lower(y) IN ({stops}))) AS stops, len(l) AS lines,
         len(list_filter(l, lambda y: regexp_matches(y, '^ *[-*•]'))) AS bullets,
         len(list_filter(l, lambda y: regexp_matches(y, '(\.\.\.|…) *$'))) AS ellipses
  FROM h LEFT JOIN c ON h.doc_id = c.doc_id
),
q AS (
  SELECT *, word_chars / greatest(n_words, 1) AS mean_word_chars, n_symbols / greatest(n_words, 1) AS symbols_per_word,
         stops / greatest(n_words, 1) AS stop_word_ratio, n_dup_lines / greatest(lines, 1) AS dup_line_ratio,
         bullets / greatest(lines, 1) AS bullet_line_ratio, ellipses / greatest(lines, 1) AS ellipsis_line_ratio,
         (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {LONGEST_REPEAT_PERCENT} * n_words) AS base_failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND {rules}) AS kept,
       mean_word_chars, symbols_per_word, stop_word_ratio, dup_line_ratio, bullet_line_ratio, ellipsis_line_ratio
FROM q
"""
