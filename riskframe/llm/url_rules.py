"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over ``host`` + ``path`` with literal tokens (runs of letters and
digits) that every url it fits must hold. Of these the index keeps the one that occurs in the fewest
distinct urls of the table. A url's tokens fetch candidate rules from the index and only those run
their expression. Host rules (a host, all its subdomains and a path prefix) are pattern rules like
any other; the longest that fits gives the verdict. Else block patterns decide; else allow.

Everything is a DataFrame expression or join. Urls are judged once each and joined back, so a url of
very many rows costs one judgement; rules are small tables that Spark may or may not broadcast by
their measured size.

Rows: a null url, or one without ://, has empty host and path, fits no rule and is allowed. Repeated
rows get equal verdicts. Columns other than those named are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class HostRule:
    verdict: str
    rule: str  # host/path prefix

    def pattern(self) -> str:
        host, _, path = self.rule.partition("/")
        return rf"^([^/]*\.)?{re.escape(host)}/{re.escape(path)}"

    def tokens(self) -> list[str]:
        """Tokens of the rule; the last of a path that ends inside a token is none."""
        host, _, path = self.rule.partition("/")
        whole = re.sub(r"[A-Za-z0-9]+$", "", path)
        return re.findall(TOKEN, (host + "/" + whole).lower())


@dataclass(frozen=True)
class PatternRule:
    pattern: str
    tokens: tuple[str, ...]


HOST_RULES = (HostRule("allow", "com/"), HostRule("block", "example.com/en/"), HostRule("allow", "www.example.com/en/"),
              HostRule("block", "net/es/"), HostRule("block", "net/fr/"))
#: Block patterns for urls that no host rule fits: a host label that joins an unwanted trade with another word.
BLOCK_PATTERNS = tuple(
    PatternRule(rf"^([^/]*\.)?([a-z0-9]+-)*{word}(-[a-z0-9]+)*\.", (word,))
    for word in ("adult", "ads", "bets", "casino", "pills", "porn", "spam", "track", "xxx")) + tuple(
    PatternRule(rf"^([^/]*\.)?{word}-[a-z0-9-]+\.", (word,)) for word in ("free", "cheap", "win", "best"))


def host_and_path(url):
    """(host, path) columns: host after the first :// up to / ? # or the end, path up to ? # or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, host_rules=HOST_RULES, block_patterns=BLOCK_PATTERNS) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages`` (page_id, url)."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url")).withColumn("host", host).withColumn("path", path)
    urls = rows.where("host <> ''").select("host", "path").distinct() \
        .withColumn("target", F.concat("host", "path"))
    tokens = F.array_distinct(F.expr(f"regexp_extract_all(translate(target, '{UPPER}', '{LOWER}'), '{TOKEN}', 0)"))
    tokened = urls.withColumn("token", F.explode(tokens))

    table = [(i, r.pattern(), r.rule, r.verdict, len(r.rule), r.tokens()) for i, r in enumerate(host_rules)]
    table += [(len(table) + i, r.pattern, None, "block", -1, list(r.tokens)) for i, r in enumerate(block_patterns)]
    rules = spark.range(0, 1, 1, 1).select(F.inline(F.array(*[F.struct(
        F.lit(i).alias("id"), F.lit(pattern).alias("pattern"), F.lit(rule).cast("string").alias("rule"), F.lit(verdict).alias("verdict"),
        F.lit(length).alias("length"), F.array(*map(F.lit, literal)).cast("array<string>").alias("tokens"))
        for i, pattern, rule, verdict, length, literal in table])))

    # each rule under the token of the fewest urls; a rule without literals is a candidate of every url
    literals = rules.select("id", F.explode("tokens").alias("token"))
    seen = tokened.join(literals.select("token").distinct(), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    index = (literals.join(seen, "token", "left").groupBy("id")
             .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
             .join(rules.drop("tokens"), "id"))
    candidates = tokened.join(index, "token")
    loose = [t for t in table if not t[5]]
    fits = candidates.where(F.expr("target rlike pattern")).select("host", "path", "rule", "verdict", "length")
    for _, pattern, rule, verdict, length, _ in loose:
        fits = fits.unionByName(urls.where(F.col("target").rlike(pattern)).select(
            "host", "path", F.lit(rule).cast("string").alias("rule"), F.lit(verdict).alias("verdict"), F.lit(length).alias("length")))
    best = fits.groupBy("host", "path").agg(F.max(F.struct("length", "rule", "verdict")).alias("best"))
    return (rows.join(best, ["host", "path"], "left")
            .select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict")))


def oracle(host_rules=HOST_RULES, block_patterns=BLOCK_PATTERNS) -> str:
    """The same verdicts in DuckDB SQL, each rule tried on every url."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    values = [f"({len(r.rule)}, {q(r.rule)}, {q(r.verdict)}, {q(r.rule.partition('/')[0])}, {q('/' + r.rule.partition('/')[2])})" for r in host_rules]
    blocked = " OR ".join(f"regexp_matches(target, {q(r.pattern)})" for r in block_patterns) or "false"
    return f"""WITH r(length, rule, verdict, h, p) AS (VALUES {", ".join(values)}),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
k AS (SELECT DISTINCT host, path, host || path AS target FROM s WHERE host <> ''),
f AS (SELECT host, path, max(struct_pack(length := length, rule := rule, verdict := verdict)) AS best FROM k JOIN r
  ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path),
b AS (SELECT host, path FROM k WHERE {blocked})
SELECT s.page_id, s.host, s.path, f.best.rule AS rule, coalesce(f.best.verdict, CASE WHEN b.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM s LEFT JOIN f ON s.host = f.host AND s.path = f.path LEFT JOIN b ON s.host = b.host AND s.path = b.path"""
