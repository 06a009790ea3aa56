"""Fill-in-middle transformation of whole texts with counted regular expressions.

The unit is one code point, ``.`` with DOTALL. ``regexp_count`` gives the number of units n; the two
cuts come from a hash of the id, so reruns agree. Each row builds its own pattern from its cuts: a
possessive group of ``unit{a}``, one of ``unit{b-a}`` and the rest. One match of it captures prefix,
middle and suffix, and the replacement names the order in which they are written. The inverse is one
match too: the three markers occur once each, as texts that contain one are left plain.

Counting takes whole blocks of units first and single units of the last block only, since
``regexp_count`` lists what it counts: the list has n / BLOCK entries, not one a code point.

Rows: null text counts as empty; empty texts and texts with a marker are plain. A null doc_id counts as
the empty string in the hash. Repeated rows give equal rows. Nothing is cut off, whatever the length.
Columns other than doc_id and text are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = "."
BLOCK = 1024
MARKERS = ("<P>", "<S>", "<M>")


def count_units(text: Column, unit: str = UNIT, block: int = BLOCK) -> Column:
    """Number of ``unit`` matches in ``text``, which they must cover from its start to its end."""
    whole = F.regexp_count(text, F.lit(f"(?s){unit}{{{block}}}+"))
    rest = F.regexp_extract(text, rf"(?s)\A(?:{unit}{{{block}}}+)*+(.*+)\z", 1)
    return (whole * block + F.regexp_count(rest, F.lit(f"(?s){unit}"))).cast("long")


def cut_pattern(a: Column, b: Column, unit: str = UNIT) -> Column:
    """Pattern whose groups are the first ``a`` units, the units up to ``b`` and the rest."""
    return F.concat(F.lit(rf"(?s)\A({unit}{{"), a, F.lit(f"}}+)({unit}{{"), b - a, F.lit(r"}+)(.*+)\z"))


def fill_in_middle(docs: DataFrame, plain_percent: int = 10, spm_percent: int = 20, salt: str = "1:") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row of ``docs``.

    ``plain_percent`` of the ids stay plain, ``spm_percent`` of the others write the suffix first.
    """
    p, s, m = MARKERS
    text = F.coalesce("text", F.lit(""))
    name = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(name, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    out = docs.select("doc_id", text.alias("text")).select("doc_id", "text", count_units(F.col("text")).alias("n"), *h)
    x, y = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    marked = F.lit(False)
    for marker in MARKERS:
        marked = marked | F.contains("text", F.lit(marker))
    plain = (F.col("n") == 0) | marked | (F.col("h3") % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    out = out.select("doc_id", "text", "n", form.alias("form"), F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    order = F.when(F.col("form") == "spm", f"{s}$3{p}$1{m}$2").otherwise(f"{p}$1{s}$3{m}$2")
    written = F.regexp_replace("text", cut_pattern(F.col("a"), F.col("b")), order)
    known = F.col("form") != "plain"
    return out.select("doc_id", "n", "form", F.when(known, F.col("a")).alias("prefix_chars"),
                      F.when(known, F.col("b") - F.col("a")).alias("middle_chars"),
                      F.when(known, written).otherwise(F.col("text")).alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` wrote as ``output`` in ``form``."""
    p, s, m = MARKERS
    pattern = F.when(form == "spm", rf"(?s)\A{s}(.*?){p}(.*?){m}(.*+)\z").otherwise(rf"(?s)\A{p}(.*?){s}(.*?){m}(.*+)\z")
    order = F.when(form == "spm", "$2$3$1").otherwise("$1$3$2")
    return F.when(form == "plain", output).otherwise(F.regexp_replace(output, pattern, order))


def oracle() -> str:
    """DuckDB SQL of op12's digest: substrings by position instead of regular expressions."""
    h = ", ".join(f"CAST('0x' || substr(s, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
c AS (SELECT doc_id, t, CAST(len(t) AS BIGINT) AS n, {h} FROM d),
k AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
       WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN t
    WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
    ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END AS output FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(output) AS output_sha256, sha256(t) AS restored_sha256 FROM o"""
