"""Quality rules whose thresholds follow each language and source.

One pass measures every whole text. Documents that pass the fixed base rules fill a quantile sketch for
each (lang, source, rule): counts of values rounded down to their seven leading bits, so a quantile is
exact to a relative 1/64 and a sketch has at most 64 counters per power of two. Sketches merge by adding
counters, in any order and with the same result: a hot source is summed in its tasks first, and a
language's sketches are the merged ones of its sources.

A rule's fences are Tukey's: the quartiles, widened by ``WIDE`` times the distance between them (at least
the rule's least spread). A group of n documents weighs its own fences by n and those of its language by
``PRIOR``, so small groups lean on their language and no size is treated apart. Documents join their
group's fences, and those inside all of them are kept.

Rows: null text has no words and fails the base rules. Null lang or source are groups of their own.
Repeated rows count and return once each. Columns other than doc_id, text, lang and source are ignored
(kept by ``kept_documents``); tables without lang or source have null there. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import bounded_batches, materialize, pieces

#: name: (numerator, denominator, per, least spread, whether low values fail too); values are per / denominator.
RULES = {
    "chars_per_word": ("word_chars", "n_words", 1000, 400, True),
    "symbols_per_word": ("n_symbols", "n_words", 1000, 50, False),
    "upper_share": ("n_upper", "word_chars", 1000, 50, False),
    "dup_line_share": ("n_dup_lines", "n_lines", 1000, 200, False),
    "repeat_share": ("n_repeat_words", "n_words", 1000, 120, False),
}
WIDE = 3
PRIOR = 30
LEAST_WORDS = 50
MOST_REPEATED = 50
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three that occur twice or more in the text, first occurrences included."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    _, window, count = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = count[window] > 1
    hit = np.zeros(len(words), bool)
    for i in range(3):
        hit[i:len(words) - 2 + i] |= again
    return int(hit.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """``MEASURES`` of one text."""
    text = text or ""
    data = text.encode()
    words = data.split()  # bytes split at exactly the six white-space characters
    lines = [line for line in text.split("\n") if line.strip(BLANK)]
    return (len(words), len(text) - sum(map(text.count, BLANK)), len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
            repeated_words(words), len(lines), len(data) - len(data.translate(None, UPPER)))


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns of ``MEASURES`` in a struct ``__m`` and base_failed in ``__failed``."""
    kind = pa.struct([(m, pa.int64()) for m in MEASURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            columns = zip(*[measure(t.as_py()) for t in b.column("text")], strict=True)
            m = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=list(kind))
            yield pa.RecordBatch.from_arrays([*b.columns, m], [*b.schema.names, "__m"])

    shape = StructType([*docs.schema.fields, StructField("__m", StructType([StructField(m, LongType()) for m in MEASURES]))])
    out = bounded_batches(docs).mapInArrow(run, shape)
    m = F.col("__m")
    failed = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED * m["n_words"])
    return out.withColumn("__failed", failed)


def rule_values(m: Column) -> dict[str, Column]:
    """Whole-number value of each rule from a struct of ``MEASURES``."""
    return {name: F.floor(F.try_divide(per * m[top], m[bottom])).cast("long") for name, (top, bottom, per, _, _) in RULES.items()}


def sketch(values: DataFrame, by: list[str]) -> DataFrame:
    """(*by, bucket, count): mergeable sketches of the column ``value`` (whole numbers from 0)."""
    extra = F.greatest(F.length(F.bin("value")) - 7, F.lit(0))
    low = F.call_function("shiftright", F.col("value"), extra)
    return values.select(*by, F.call_function("shiftleft", low, extra).alias("bucket")).groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("count"))


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The sketches of all rows that agree in ``by``, merged."""
    return sketches.groupBy(*by, "bucket").agg(F.sum("count").alias("count"))


def quartiles(sketches: DataFrame, by: list[str]) -> DataFrame:
    """(*by, n, q1, q3) from sketches; a window holds one sketch, whose size is bounded."""
    group = Window.partitionBy(*by)
    run = sketches.select(*by, "bucket", F.sum("count").over(group.orderBy("bucket")).alias("upto"), F.sum("count").over(group).alias("n"))
    at = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("n"), F.col("bucket")))  # noqa: E731
    return run.groupBy(*by).agg(F.max("n").alias("n"), at(1).alias("q1"), at(3).alias("q3"))


def fences(sketches: DataFrame) -> DataFrame:
    """One row per (lang, source): low_<rule> and high_<rule>, whole numbers; a document inside all is kept."""
    least = F.create_map(*[F.lit(x) for name, rule in RULES.items() for x in (name, rule[3])])
    spread = F.greatest(F.col("q3") - F.col("q1"), least[F.col("rule")])
    ends = {"low": F.greatest(F.col("q1") - WIDE * spread, F.lit(0)), "high": F.col("q3") + WIDE * spread}
    own = quartiles(sketches, ["lang", "source", "rule"]).select("lang", "source", "rule", "n", *[c.alias(k) for k, c in ends.items()])
    wider = quartiles(merge(sketches, ["lang", "rule"]), ["lang", "rule"]).select(F.col("lang").alias("l"), F.col("rule").alias("r"), *[c.alias(f"lang_{k}") for k, c in ends.items()])
    both = own.join(wider, F.col("lang").eqNullSafe(F.col("l")) & (F.col("rule") == F.col("r")))
    blend = lambda k: F.floor((F.col("n") * F.col(k) + PRIOR * F.col(f"lang_{k}")) / (F.col("n") + PRIOR))  # noqa: E731
    pick = lambda k, name: F.max(F.when(F.col("rule") == name, blend(k))).alias(f"{k}_{name}")  # noqa: E731
    return both.groupBy("lang", "source").agg(*[pick(k, name) for name in RULES for k in ("low", "high")])


def _judged(rows: DataFrame) -> DataFrame:
    """``rows`` of ``measured`` (lang, source) with the column ``__kept``, through the joined fences."""
    values = rule_values(F.col("__m"))
    long = rows.where("not __failed").select("lang", "source", F.inline(F.array(*[
        F.struct(F.lit(name).alias("rule"), v.alias("value")) for name, v in values.items()])))
    limits = fences(materialize(sketch(long, ["lang", "source", "rule"])))
    limits = limits.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), *[F.col(c).alias(f"__{c}") for c in limits.columns[2:]])
    inside = [values[name] <= F.col(f"__high_{name}") for name in RULES]
    inside += [values[name] >= F.col(f"__low_{name}") for name, rule in RULES.items() if rule[4]]
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    kept = ~F.col("__failed") & F.coalesce(reduce(lambda a, b: a & b, inside), F.lit(False))
    return joined.withColumn("__kept", kept)


def _named(docs: DataFrame) -> DataFrame:
    for c in ("lang", "source"):
        docs = docs if c in docs.columns else docs.withColumn(c, F.lit(None).cast("string"))
    return docs


def judge_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, *MEASURES, base_failed, kept) for every row of ``docs``."""
    rows = measured(_named(docs).select("doc_id", "lang", "source", "text"))
    rows = materialize(rows.select("doc_id", "lang", "source", "__m", "__failed"))
    return _judged(rows).select("doc_id", "__m.*", F.col("__failed").alias("base_failed"), F.col("__kept").alias("kept"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    rows = materialize(measured(_named(docs)))
    return _judged(rows).where("__kept").select(*docs.columns)


def oracle() -> str:
    """DuckDB SQL of op13: the same rules, sketches and fences over whole tables."""
    value = lambda name: f"({RULES[name][2]} * {RULES[name][0]}) // nullif({RULES[name][1]}, 0)"  # noqa: E731
    rules = " UNION ALL ".join(f"SELECT lang, source, '{name}' AS rule, {value(name)} AS v FROM m WHERE NOT base_failed" for name in RULES)
    least = " ".join(f"WHEN '{name}' THEN {rule[3]}" for name, rule in RULES.items())
    ends = f"""greatest(q1 - {WIDE} * greatest(q3 - q1, CASE rule {least} END), 0) AS low, q3 + {WIDE} * greatest(q3 - q1, CASE rule {least} END) AS high"""

    def quartiles_of(table: str, by: str) -> str:
        return f"""SELECT {by}, max(n) AS n, min(bucket) FILTER (WHERE 4 * upto >= n) AS q1, min(bucket) FILTER (WHERE 4 * upto >= 3 * n) AS q3 FROM (
  SELECT *, sum(c) OVER (PARTITION BY {by} ORDER BY bucket) AS upto, sum(c) OVER (PARTITION BY {by}) AS n FROM {table}) GROUP BY {by}"""

    blend = lambda k: f"(o.n * o.{k} + {PRIOR} * w.{k}) // (o.n + {PRIOR})"  # noqa: E731
    limits = ", ".join(f"max({blend(k)}) FILTER (WHERE o.rule = '{name}') AS {k}_{name}" for name in RULES for k in ("low", "high"))
    inside = [f"{value(name)} <= high_{name}" for name in RULES] + [f"{value(name)} >= low_{name}" for name, rule in RULES.items() if rule[4]]
    return rf"""WITH t AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT rid, regexp_extract_all(text, '[^ 	-]+') AS ws FROM t)),
g AS (SELECT rid, i, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, w, w2, w3) AS c FROM g WHERE w3 IS NOT NULL) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT j) AS k FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY rid),
wn AS (SELECT rid, count(*) AS k, sum(len(w)) AS chars FROM w GROUP BY rid),
ln AS (SELECT rid, count(*) AS k, count(DISTINCT line) AS d FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM t)
  WHERE regexp_matches(line, '[^ 	-]') GROUP BY rid),
b AS (SELECT doc_id, lang, source, coalesce(wn.k, 0) AS n_words, CAST(coalesce(wn.chars, 0) AS BIGINT) AS word_chars,
  CAST(len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(ln.k - ln.d, 0) AS n_dup_lines,
  coalesce(rep.k, 0) AS n_repeat_words, coalesce(ln.k, 0) AS n_lines, CAST(len(text) - len(regexp_replace(text, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper
  FROM t LEFT JOIN wn USING (rid) LEFT JOIN ln USING (rid) LEFT JOIN rep USING (rid)),
m AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM b),
v AS ({rules}),
s AS (SELECT lang, source, rule, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) AS bucket, count(*) AS c FROM v GROUP BY ALL),
sl AS (SELECT lang, rule, bucket, sum(c) AS c FROM s GROUP BY ALL),
o AS (SELECT lang, source, rule, n, {ends} FROM ({quartiles_of('s', 'lang, source, rule')})),
wl AS (SELECT lang, rule, {ends} FROM ({quartiles_of('sl', 'lang, rule')})),
f AS (SELECT o.lang, o.source, {limits} FROM o JOIN wl AS w ON o.lang IS NOT DISTINCT FROM w.lang AND o.rule = w.rule GROUP BY o.lang, o.source)
SELECT doc_id, {", ".join(MEASURES)}, base_failed, NOT base_failed AND coalesce({" AND ".join(inside)}, false) AS kept
FROM m LEFT JOIN f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source"""
