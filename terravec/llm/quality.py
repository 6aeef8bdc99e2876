"""Quality rules with thresholds that the corpus sets: quantile sketches per language and source instead of fixed cutoffs.

Each document gets a few counts and, from them, four measures. A sketch of a measure is a histogram whose bins keep the leading
bits of a value: its size is bounded, a quantile is right to one part in 256, and two sketches merge by adding up, so results
don't depend on the order or number of partitions. The sketches of each (language, source) are merged into those of each
language and of the whole corpus, over the documents that the base rules let pass. A measure's fence is a high quantile plus a
multiple of its distance from a lower one; a group's quantiles are blended with its language's, and these with the corpus's, by
their numbers of rows. A group without any spread allows for the least step of the measure in a text of that length. The
thresholds, one row for each group, are then joined to the documents. Sketches are aggregates, so a source with a third of all
rows is combined before the shuffle. All of it is DataFrame functions.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terravec.llm.common import SPACE, cut, table, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: The parent's quantiles count as much as so many rows of the group.
PRIOR_ROWS = 100
#: Measures are whole numbers of this part of one.
SCALE = 1_000_000
#: Leading bits of a value that a sketch keeps.
BITS = 9


class Measure(NamedTuple):
    """part / of: the counts whose quotient it is. low, high: the quantiles (binary fractions, so ranks are exact). fence: the
    multiple of their distance. step: the least that part grows by. below: whether small values are out too."""

    part: str
    of: str
    low: float
    high: float
    fence: float
    step: int
    below: bool


#: Quartiles where most texts are alike; the last 128th where clean texts differ (repeats), for the base rules bound those already.
MEASURES = {
    "symbol_share": Measure("n_symbols", "word_chars", 0.25, 0.75, 3.0, 1, False),
    "word_length": Measure("word_chars", "n_words", 0.25, 0.75, 3.0, 0, True),
    "dup_line_share": Measure("n_dup_lines", "n_lines", 0.5, 127 / 128, 1.0, 1, False),
    "repeat_share": Measure("n_repeat_words", "n_words", 0.5, 127 / 128, 1.0, 6, False),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def _shift(name: str, c: Column, b: Column) -> Column:
    return F.call_function(name, c, b)


def _bits(n: Column) -> Column:
    """Bits that hold a whole number from 0 on."""
    return F.length(F.bin(n))


def text_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines and n_repeat_words (all long); null text: zeros.

    Windows of three words are compared by 64-bit hashes within their own text. The leading bits of a hash and its position
    share a long, whose sort brings equal windows together; where different hashes agree in these bits, pairs are sorted.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.withColumn("_w", words(F.col(text_col))).withColumn("_l", F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != ""))
    d = d.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.char_length(F.array_join("_w", "")).cast("long"),
        "n_symbols": F.char_length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long"),
        "n_lines": F.size("_l").cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "_x": F.transform("_w", lambda w: F.xxhash64(w)),
    }).drop("_w", "_l")
    d = d.withColumn("_h", F.when(F.size("_x") >= 3, F.transform(F.sequence(F.lit(0), F.size("_x") - 3), lambda i: F.xxhash64(F.get("_x", i), F.get("_x", i + 1), F.get("_x", i + 2)))).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("_b", _bits(F.size("_x"))).drop("_x")
    lead = lambda x: _shift("shiftright", x, F.col("_b"))
    index = lambda x: x.bitwiseAND(_shift("shiftleft", F.lit(1).cast("long"), F.col("_b")) - 1).cast("int")
    like = lambda x, y: F.coalesce(lead(x) == lead(y), F.lit(False))
    d = d.withColumn("_s", F.sort_array(F.transform("_h", lambda h, i: _shift("shiftleft", lead(h), F.col("_b")).bitwiseOR(i.cast("long")))))
    d = d.withColumn("_c", F.filter("_s", lambda x, i: like(x, F.get("_s", i - 1)) | like(x, F.get("_s", i + 1)))).drop("_s")
    differs = F.filter("_c", lambda x, i: like(x, F.get("_c", i - 1)) & (F.get("_h", index(x)) != F.get("_h", index(F.get("_c", i - 1)))))
    pairs = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    exact = F.transform(F.filter(pairs, lambda x, i: same(x, F.get(pairs, i - 1)) | same(x, F.get(pairs, i + 1))), lambda x: x["i"])
    d = d.withColumn("_p", F.sort_array(F.when(F.size(differs) > 0, exact).otherwise(F.transform("_c", index)))).drop("_c", "_h", "_b")
    covered = F.transform("_p", lambda p, i: F.when(i == 0, F.lit(3)).otherwise(F.least(F.lit(3), p - F.get("_p", i - 1))))
    return d.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)).drop("_p")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def measures(counted: DataFrame) -> DataFrame:
    """Adds the measures as whole numbers of SCALE; null where there is nothing to divide by."""
    share = lambda m: F.when(F.col(m.of) > 0, F.expr(f"{m.part} * {SCALE}L div {m.of}"))
    return counted.withColumns({name: share(m) for name, m in MEASURES.items()})


def sketches(measured: DataFrame, by: list[str]) -> DataFrame:
    """(by, measure, bin, n): the histogram of each measure of each group; bin is the smallest value of its bin."""
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("measure"), F.col(name).alias("v")) for name in MEASURES)))
    rows = measured.select(*by, each.alias("_m")).filter("_m.v IS NOT NULL")
    v = F.col("_m.v")
    drop = F.greatest(_bits(v) - BITS, F.lit(0))
    return rows.select(*by, F.col("_m.measure").alias("measure"), _shift("shiftleft", _shift("shiftright", v, drop), drop).alias("bin")).groupBy(*by, "measure", "bin").agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, and for each measure its low and high quantile): the bin that the rank falls in, by its smallest and largest value."""
    merged = sketch.groupBy(*by, "measure", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "measure")
    ranked = merged.withColumns({"upto": F.sum("n").over(group.orderBy("bin")), "total": F.sum("n").over(group)})
    width = _shift("shiftleft", F.lit(1).cast("long"), F.greatest(_bits(F.col("bin")) - BITS, F.lit(0)))
    reached = lambda name, q: (F.col("measure") == name) & (F.col("upto") >= F.ceil(F.col("total") * F.lit(q)))
    out = [F.max("total").alias("n")]
    for name, m in MEASURES.items():
        out += [F.min(F.when(reached(name, m.low), F.col("bin"))).alias(f"{name}_lo"), F.min(F.when(reached(name, m.high), F.col("bin") + width - 1)).alias(f"{name}_hi")]
    return ranked.groupBy(*by).agg(*out)


def thresholds(measured: DataFrame, lang: str, source: str, prior: int = PRIOR_ROWS) -> DataFrame:
    """One row per (lang, source) of measured: the quantiles <measure>_lo and <measure>_hi (double), blended. Nulls are groups of their own."""
    sketch = cut(sketches(measured, [lang, source]))
    whole = quantiles(sketch, []).select(*(F.col(f"{m}_{x}").alias(f"a_{m}_{x}") for m in MEASURES for x in ("lo", "hi")))
    per_lang = quantiles(sketch, [lang])
    per_lang = per_lang.select(F.col(lang).alias("_lang"), *(F.col(c).alias(f"l_{c}") for c in per_lang.columns if c != lang))
    own = quantiles(sketch, [lang, source])
    both = own.join(per_lang, own[lang].eqNullSafe(per_lang["_lang"])).join(F.broadcast(whole))  # one row
    mixed = lambda n, x, parent: (F.col(n) * F.coalesce(F.col(x).cast("double"), F.lit(0.0)) + prior * parent) / (F.col(n) + prior)
    limit = lambda m, x: mixed("n", f"{m}_{x}", mixed("l_n", f"l_{m}_{x}", F.coalesce(F.col(f"a_{m}_{x}").cast("double"), F.lit(0.0))))
    return both.select(F.col(lang).alias("_lang"), F.col(source).alias("_source"), *(limit(m, x).alias(f"{m}_{x}") for m in MEASURES for x in ("lo", "hi")))


def judged(docs: DataFrame, text_col: str = "text", lang: str = "lang", source: str = "source", keep: list[str] | None = None) -> DataFrame:
    """The columns keep of each row (a key) with its counts, base_failed and kept.

    base_failed: under 50 words, or over half of the words in repeated windows. kept: not base_failed and within the
    thresholds of its group. A null or empty text fails. A text of any length is counted whole. Null languages and sources are
    groups; rows stay as many as they are, and repeated ones get equal verdicts; ties at a threshold are kept; an empty table
    gives an empty result. The columns keep may have any names but those of the counts, base_failed and kept.
    """
    keep = keep or ["doc_id"]
    key = F.struct(*(F.col(f"`{c}`") for c in keep)).alias("_key")
    counted = text_counts(docs.select(key, F.col(lang).alias("_g_lang"), F.col(source).alias("_g_source"), F.col(text_col).alias("_text")), "_text")
    counted = cut(counted.select("_key", "_g_lang", "_g_source", *COUNTS, base_failed().alias("base_failed")))
    measured = measures(counted)
    limits = cut(thresholds(measured.filter("NOT base_failed"), "_g_lang", "_g_source"))
    limits = limits.select("_lang", "_source", *(F.col(c).alias(f"_{c}") for c in limits.columns[2:]))
    met = measured.join(limits, measured["_g_lang"].eqNullSafe(limits["_lang"]) & measured["_g_source"].eqNullSafe(limits["_source"]), "left")
    within = F.lit(True)
    for name, m in MEASURES.items():
        lo, hi, v = F.col(f"_{name}_lo"), F.col(f"_{name}_hi"), F.coalesce(F.col(name), F.lit(0))
        slack = F.lit(m.fence) * F.greatest(hi - lo, F.coalesce(F.lit(float(m.step * SCALE)) / F.when(F.col(m.of) > 0, F.col(m.of)), F.lit(0.0)))
        within = within & (v <= hi + slack)
        if m.below:
            within = within & (v >= lo - slack)
    return met.select("_key.*", *COUNTS, "base_failed", (~F.col("base_failed") & F.coalesce(within, F.lit(False))).alias("kept"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql_bin(v: str, last: bool) -> str:
    """The smallest, or the largest, value of v's bin."""
    drop = f"greatest(length(bin({v})) - {BITS}, 0)"
    return f"((({v} >> {drop}) << {drop}) + {f'(1::BIGINT << {drop}) - 1' if last else '0'})"


def _sql_blend(name: str, x: str) -> str:
    mixed = lambda n, v, parent: f"(({n} * coalesce({v}::DOUBLE, 0) + {PRIOR_ROWS} * {parent}) / ({n} + {PRIOR_ROWS}))"
    return mixed("g.n", f"g.{name}_{x}", mixed("l.n", f"l.{name}_{x}", f"coalesce(a.{name}_{x}::DOUBLE, 0)"))


def _sql_within(name: str, m: Measure) -> str:
    lo, hi, v = f"t.{name}_lo", f"t.{name}_hi", f"coalesce({name}, 0)"
    slack = f"{m.fence} * greatest({hi} - {lo}, coalesce({float(m.step * SCALE)}::DOUBLE / nullif({m.of}, 0), 0))"
    return f"{v} <= {hi} + {slack}" + (f" AND {v} >= {lo} - {slack}" if m.below else "")


_QUANTILES = ", ".join(f"quantile_disc({_sql_bin(name, last)}, {q}) AS {name}_{t}" for name, m in MEASURES.items() for q, t, last in ((m.low, "lo", False), (m.high, "hi", True)))
OP6_SQL = f"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM documents),
t AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM t),
p AS (SELECT doc_id, count(DISTINCT i + d) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) AS o(d) WHERE n > 1 GROUP BY doc_id),
c AS (
  SELECT w.doc_id, lang, source, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN p USING (doc_id)),
m AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
         {", ".join(f"CAST({x.part} AS BIGINT) * {SCALE} // nullif({x.of}, 0) AS {name}" for name, x in MEASURES.items())}
  FROM c),
g AS (SELECT lang, source, count(*) AS n, {_QUANTILES} FROM m WHERE NOT base_failed GROUP BY ALL),
l AS (SELECT lang, count(*) AS n, {_QUANTILES} FROM m WHERE NOT base_failed GROUP BY ALL),
a AS (SELECT {_QUANTILES} FROM m WHERE NOT base_failed),
t2 AS (SELECT g.lang, g.source, {", ".join(f"{_sql_blend(name, x)} AS {name}_{x}" for name in MEASURES for x in ("lo", "hi"))} FROM g JOIN l ON g.lang IS NOT DISTINCT FROM l.lang, a)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce({" AND ".join(_sql_within(name, m) for name, m in MEASURES.items())}, FALSE) AS kept
FROM m LEFT JOIN t2 AS t ON m.lang IS NOT DISTINCT FROM t.lang AND m.source IS NOT DISTINCT FROM t.source
"""
