"""Text plans over whole documents and pages."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from ..functions._util import round_half_away as rnd
from ..ml import tfidf as TF
from ..session import cut_lineage, read_table, spread
from . import sqlfrag as S

R9 = 9
# Corpus-fitting keyword patterns (the default security dictionary finds nothing in these texts;
# literal-row tests cover it).
DOC_PATTERNS = {
    "has_apache_keyword": r"\b(apache)\b",
    "has_license_keyword": r"\b(licen[cs]e[sd]?)\b",
    # one local-part character before '@' decides existence exactly as a run of them would,
    # without the quadratic backtracking of a leading '+'
    "has_email_keyword": r"[a-z0-9._+-]@[a-z0-9-]+\.[a-z]",
}
# Whitespace set of Python str.split(), as an explicit class both regex engines accept.
WS_SQL = r"[\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def text_features(spark: SparkSession, sf_dir: str):
    """H4/H5: length, word count, keyword flags and vendor flags for every document (whole text)."""
    d = spread(read_table(spark, sf_dir, "documents"), "doc_id")
    flags = T.keyword_flags("text", DOC_PATTERNS)
    vt = T.vendor_text(F.lit(""), F.col("source"), F.array().cast("array<string>"), F.col("text"))
    vend = T.vendor_flags(vt, None, ["apache", "linux", "oracle", "google"])
    return d.select("doc_id", T.char_length("text").alias("description_length"),
                    T.word_count("text").alias("description_word_count"),
                    *[c.alias(n) for n, c in flags.items()], *[c.alias(n) for n, c in vend.items()])


def _text_features_sql() -> str:
    flags = ", ".join(f"CAST(coalesce(regexp_matches(coalesce(text, ''), '(?i){p}'), false) AS INTEGER) AS {n}"
                      for n, p in DOC_PATTERNS.items())
    vt = "lower(concat_ws(' ', '', coalesce(source, ''), '', coalesce(text, '')))"
    vnames = ["apache", "linux", "oracle", "google"]
    vflags = ", ".join(f"CAST(position('{v}' IN {vt}) > 0 AS INTEGER) AS vendor_{v}" for v in vnames)
    anyv = "greatest(" + ", ".join(f"CAST(position('{v}' IN {vt}) > 0 AS INTEGER)" for v in vnames) + ")"
    return f"""SELECT doc_id, length(coalesce(text, '')) AS description_length,
  len(list_filter(regexp_split_to_array(coalesce(text, ''), '{WS_SQL}'), lambda t: t <> '')) AS description_word_count,
  {flags}, {vflags}, 1 - {anyv} AS vendor_other, {anyv} AS vendor_count FROM documents"""


def page_references(spark, sf_dir):
    """H10/A4e: reference URLs = page url + every href in the html; count and patch/exploit flags."""
    p = spread(read_table(spark, sf_dir, "pages"), "page_id")
    urls = F.filter(F.concat(F.array(F.col("url")), F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1)),
                    lambda u: u.isNotNull() & (u != ""))
    r = T.reference_features(urls)
    return p.select("page_id", *[c.alias(n) for n, c in r.items()])


def _page_refs_sql() -> str:
    urls = ("list_filter(list_concat([url], regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)), "
            "lambda u: u IS NOT NULL AND u <> '')")
    joined = f"lower(array_to_string({urls}, ' '))"
    patch = "greatest(" + ", ".join(f"CAST(position('{w}' IN {joined}) > 0 AS INTEGER)" for w in K.PATCH_WORDS) + ")"
    expl = "greatest(" + ", ".join(f"CAST(position('{w}' IN {joined}) > 0 AS INTEGER)" for w in K.EXPLOIT_WORDS) + ")"
    return f"""SELECT page_id, CAST(len({urls}) AS INTEGER) AS reference_count, {patch} AS has_patch_reference,
  {expl} AS has_exploit_reference FROM pages"""


def _docs(spark, sf_dir):
    return spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def tfidf_vocabulary(spark, sf_dir):
    """J1 fit on all documents: top-100 terms with df, corpus count, idf and index."""
    v = TF.fit(_docs(spark, sf_dir), "text", "doc_id")
    return v.select("term", "index", "df", "corpus_count", rnd("idf", R9).alias("idf"))


def tfidf_weights(spark, sf_dir):
    """J1 transform: L2-normalised tf-idf weight of every vocabulary term present in each document."""
    d = _docs(spark, sf_dir)
    t = TF.transform(d, cut_lineage(TF.fit(d, "text", "doc_id")), "text", "doc_id")
    return t.select("doc_id", "index", rnd("tfidf", R9).alias("tfidf"))


def _terms_sql() -> str:
    stop = ", ".join("'" + w.replace("'", "''") + "'" for w in TF.spark_english_stop_words())
    return f"""WITH d AS (SELECT doc_id, text FROM documents),
tk AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '{TF.TOKEN_REGEX}'),
  lambda t: NOT list_contains([{stop}], t)) AS t FROM d),
g AS (SELECT doc_id, list_concat(t, CASE WHEN len(t) >= 2 THEN list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) ELSE [] END) AS g FROM tk),
terms AS (SELECT doc_id, unnest(g) AS term FROM g),
n AS (SELECT count(*) AS n FROM d),
stats AS (SELECT term, count(*) AS corpus_count, count(DISTINCT doc_id) AS df FROM terms GROUP BY term),
top AS (SELECT * FROM stats ORDER BY corpus_count DESC, term LIMIT 100),
vocab AS (SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS index, df, corpus_count,
  ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM top, n)
"""


def _vocab_sql() -> str:
    return _terms_sql() + f"SELECT term, index, df, corpus_count, {S.round_dp('idf', R9)} AS idf FROM vocab"


def _weights_sql() -> str:
    return _terms_sql() + f""",
tf AS (SELECT t.doc_id, v.index, v.idf, count(*) AS tf FROM terms t JOIN vocab v USING (term) GROUP BY ALL),
w AS (SELECT *, tf * idf AS w FROM tf),
nr AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id)
SELECT doc_id, index, {S.round_dp('w / norm', R9)} AS tfidf FROM w JOIN nr USING (doc_id)"""


QUERIES = {
    "text_features": (text_features, _text_features_sql()),
    "page_references": (page_references, _page_refs_sql()),
    "tfidf_vocabulary": (tfidf_vocabulary, _vocab_sql()),
    "tfidf_weights": (tfidf_weights, _weights_sql()),
}
