"""Quality rules whose thresholds come from the documents of each language and source.

Every rule is a whole number a document, so many in a thousand. Its values are
counted in a sketch: a value keeps its six leading bits, and a sketch is how
many documents have each such value. Sketches of the parts of a corpus are
merged by adding counts, the same whatever the parts; a quantile is exact to
one part in 32. A limit lies above the upper quartile of its language and source
by three times what lies between the quartiles, and a slack of its own; the
language's quartiles, from merged sketches, weigh as much as PRIOR documents
of the source, so a source with few documents is judged by its language.

Built-in functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import discard, join_counted, materialise, table

SPACES, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50
WINDOW = 3
#: Documents of a source that its language counts for.
PRIOR = 200
#: Distance of a limit from the upper quartile, in distances between the quartiles.
SPREADS = 3
KEYS = ["lang_key", "source_key", "nulls"]


@dataclass(frozen=True)
class Rule:
    """What a document may have: a share in a thousand, and how far above the spread of its like it may lie at least."""

    name: str
    part: str
    whole: str
    slack: int


RULES = (
    Rule("length", "word_chars", "n_words", 500),
    Rule("symbols", "n_symbols", "n_words", 100),
    Rule("lines", "n_dup_lines", "n_lines", 350),
    Rule("repeats", "n_repeat_words", "n_words", 300),
)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each document, from its whole text; null counts as empty."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "lang", "source", text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD))
    rows = rows.select(
        "doc_id", "lang", "source",
        F.length(F.regexp_replace("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"), F.array_remove(F.split("text", SPACES), "").alias("words"),
    )
    n = F.size("words")
    windows = F.transform(F.slice("words", 1, F.greatest(n - WINDOW + 1, F.lit(0))), lambda w, i: F.xxhash64(w, *(F.get("words", i + k) for k in range(1, WINDOW))))
    rows = rows.select(
        "doc_id", "lang", "source", "word_chars", "n_symbols", n.cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), windows.alias("windows"),
    )
    # Equal windows are neighbours once sorted; most texts have none, and needn't sort.
    once = F.size(F.array_distinct("windows")) == F.size("windows")
    placed = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("placed", F.when(~once, placed)).drop("windows")
    return rows.select("doc_id", "lang", "source", "n_words", "n_lines", "word_chars", "n_symbols", "n_dup_lines", _repeated().cast("long").alias("n_repeat_words"))


def _repeated() -> Column:
    """Words that the windows of ``placed`` cover which equal a neighbour; 0 where it is NULL."""
    same = lambda k, other: F.coalesce(F.get("placed", k)["h"] == F.get("placed", other)["h"], F.lit(False))
    at = F.filter(F.transform("placed", lambda _, k: k), lambda k: same(k, k - 1) | same(k, k + 1))
    words = F.flatten(F.transform(at, lambda k: F.sequence(F.get("placed", k)["i"], F.get("placed", k)["i"] + (WINDOW - 1))))
    return F.when(F.col("placed").isNull(), 0).otherwise(F.size(F.array_distinct(words)))


def leading_bits(value: Column) -> Column:
    """A whole number with all but its six leading bits cleared."""
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift := F.greatest(F.length(F.bin(value)) - 6, F.lit(0))), shift)


def _share(rule: Rule) -> Column:
    return F.expr(f"1000 * {rule.part} div greatest({rule.whole}, 1)")


def sketches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rule, value, n): how many documents have each value of each rule. Counted before the shuffle; a few hundred rows a group."""
    values = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), leading_bits(F.col(r.name)).alias("value")) for r in RULES)))
    return rows.select(*keys, values.alias("v")).groupBy(*keys, F.col("v.rule").alias("rule"), F.col("v.value").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of larger groups from those of their parts."""
    return sketch.groupBy(*keys, "rule", "value").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rule, total, low, high): the number of values, and the lower and upper quartile."""
    upto = Window.partitionBy(*keys, "rule").orderBy("value")
    rows = sketch.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(Window.partitionBy(*keys, "rule"))})
    at = lambda parts: F.min(F.when(4 * F.col("upto") >= parts * F.col("total"), F.col("value")))
    return rows.groupBy(*keys, "rule").agg(F.max("total").alias("total"), at(1).alias("low"), at(3).alias("high"))


def limits(sketch: DataFrame) -> DataFrame:
    """(KEYS, rule names): the most that a document of each language and source may have of each rule."""
    language = ["lang_key", "no_lang"]
    sketch = sketch.withColumn("no_lang", F.expr("nulls div 2"))
    own = quartiles(sketch, [*KEYS, "no_lang"])
    whole = quartiles(merged(sketch, language), language).select(*language, "rule", F.col("low").alias("w_low"), F.col("high").alias("w_high"))
    both = own.join(whole, [*language, "rule"])
    blend = lambda q: F.expr(f"(total * {q} + {PRIOR} * w_{q}) div (total + {PRIOR})")
    both = both.withColumns({"low": blend("low"), "high": blend("high")}).withColumn("base", F.col("high") + SPREADS * (F.col("high") - F.col("low")))
    return both.groupBy(*KEYS).agg(*(F.max(F.when(F.col("rule") == r.name, F.col("base") + r.slack)).alias(f"most_{r.name}") for r in RULES))


def filtered(docs: DataFrame) -> DataFrame:
    """All documents with their counts, limits and ``kept``; see ``op12_quality_rules``."""
    rows = statistics(docs).withColumns({
        "base_failed": (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")),
        "lang_key": F.coalesce("lang", F.lit("")), "source_key": F.coalesce("source", F.lit("")),
        "nulls": 2 * F.col("lang").isNull().cast("int") + F.col("source").isNull().cast("int"),
        **{r.name: _share(r) for r in RULES},
    })
    rows = materialise(rows, "statistics")
    sketch = materialise(sketches(rows.filter("NOT base_failed"), KEYS), "sketches")
    sizes = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    most = materialise(sizes.join(limits(sketch), KEYS, "left"), "limits")
    discard(sketch)
    within = F.lit(True)
    for r in RULES:
        within = within & (F.col(r.name) <= F.col(f"most_{r.name}"))
    out = join_counted(rows, most, KEYS, rows.count())
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(False))).drop(*KEYS, "n")


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document and whether it is kept.

    Documents that fail the base rules are dropped, and are in no sketch. A
    null language or source is one of its own. Null, empty and blank texts
    have no words and fail. Rows that repeat are judged, and counted, one by
    one. Windows are compared by 64-bit hashes within one text. An empty
    table gives an empty result.
    """
    return filtered(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _oracle() -> str:
    values = " UNION ALL ".join(f"SELECT doc_id, lang, source, base_failed, '{r.name}' AS rule, 1000 * {r.part} // greatest({r.whole}, 1) AS v, {r.slack} AS slack FROM s" for r in RULES)
    quartile = lambda part, keys: f"min(b) FILTER (4 * u_{keys} >= {part} * t_{keys})"
    return rf"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM h WHERE n > 1) GROUP BY doc_id),
c AS (SELECT w.doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(len(lines) AS BIGINT) AS n_lines, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
s AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM c),
v AS ({values}),
b AS (SELECT *, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS b FROM v WHERE NOT base_failed),
q AS (SELECT *, count(*) OVER (PARTITION BY lang, source, rule ORDER BY b) AS u_own, count(*) OVER (PARTITION BY lang, source, rule) AS t_own,
  count(*) OVER (PARTITION BY lang, rule ORDER BY b) AS u_lang, count(*) OVER (PARTITION BY lang, rule) AS t_lang FROM b),
o AS (SELECT lang, source, rule, any_value(slack) AS slack, any_value(t_own) AS t, {quartile(1, 'own')} AS low, {quartile(3, 'own')} AS high FROM q GROUP BY lang, source, rule),
l AS (SELECT lang, rule, {quartile(1, 'lang')} AS low, {quartile(3, 'lang')} AS high FROM q GROUP BY lang, rule),
m AS (SELECT o.lang, o.source, o.rule, slack, (t * o.low + {PRIOR} * l.low) // (t + {PRIOR}) AS low, (t * o.high + {PRIOR} * l.high) // (t + {PRIOR}) AS high
  FROM o JOIN l ON o.lang IS NOT DISTINCT FROM l.lang AND o.rule = l.rule),
k AS (SELECT v.doc_id, bool_and(NOT v.base_failed AND coalesce(v.v <= m.high + {SPREADS} * (m.high - m.low) + m.slack, false)) AS kept
  FROM v LEFT JOIN m ON v.lang IS NOT DISTINCT FROM m.lang AND v.source IS NOT DISTINCT FROM m.source AND v.rule = m.rule GROUP BY v.doc_id)
SELECT s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM s JOIN k ON s.doc_id = k.doc_id
"""


ORACLE = _oracle()
