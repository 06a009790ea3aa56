"""Spelling variants of a corpus's words by asymmetric q-chunks.

Words within one edit of each other are found by an equality join. A word of L code points gives two
disjoint chunks of q = L // 2 code points, at 0 and at q; the other word, of L or L + 1 code points,
gives its positional grams of that length. One edit damages at most one chunk, so the other is a gram of
the other word: the first at position 0, the second shifted by the difference of the lengths, 0 or 1.
Grams at other positions can match no chunk and are not sent. What joins is verified by edit distance.

A key is (chunk, its position, L, other length), so a key's group holds words that share half their
letters at the same place and have the same length; the pairs in such a group grow with the square of the
words in it, as in any join on a shared part, and AQE splits large groups. Words are counted with a
map-side aggregation: a word that is a third of the corpus costs one row a task. The vocabulary and the
links are written tables.

Rows: null text has no words; a null doc_id counts as the empty string where the id is hashed. Repeated
rows count once each. Ties of n go to the smaller word in code-point order. Columns other than doc_id and
text are ignored. Without words the result is empty.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

RUNS = "[A-Za-zÀ-ÿ]+"


def corpus_words(docs: DataFrame, least_length: int = 6, least_count: int = 5, slip: int = 199) -> DataFrame:
    """(word, n) of all words of ``docs``.

    A word is a run of letters with A-Z lower-cased. Where ``slip`` divides the crc32 of
    ``<doc_id>:<run>``, that run loses its code point number crc32 % length: planted misspellings.
    """
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"),
                       F.explode(F.regexp_extract_all(lower, F.lit(RUNS), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= least_length)
    named = runs.select("run", F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.expr("substring(run, 1, cast(h % length(run) as int))"), F.substr("run", at + 2))
    word = F.when(F.col("h") % slip == 0, cut).otherwise(F.col("run"))
    return (named.select(word.alias("word")).where(F.length("word") >= least_length)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b): every pair of distinct words of ``words`` (column word) at edit distance one, once."""
    w = words.select("word", F.length("word").alias("size"))
    entry = lambda size, at, length, other: F.struct(
        F.substring("word", at + 1, length).alias("chunk"), at.alias("at"), size.alias("owner"), other.alias("other"))
    size = F.col("size")
    half, zero = F.floor(size / 2).cast("int"), F.lit(0)
    keys = ["chunk", "at", "owner", "other"]
    chunks = w.select(F.col("word").alias("a"), F.inline(F.array(*[
        entry(size, at, half, size + d) for d in (0, 1) for at in (zero, half)])))
    grams = []
    for d in (0, 1):  # of this word's grams, those that a chunk of a word shorter by d can equal
        q = F.floor((size - d) / 2).cast("int")
        grams += [F.struct(F.substring("word", at + shift + 1, q).alias("chunk"), at.alias("at"), (size - d).alias("owner"), size.alias("other"))
                  for at, shift in ((zero, 0), (q, d))]
    grams = w.select(F.col("word").alias("b"), F.inline(F.array(*grams)))
    joined = chunks.join(grams, keys).where((F.col("owner") < F.col("other")) | (F.col("a") < F.col("b")))
    return joined.where(F.levenshtein("a", "b", 1) == 1).select("a", "b").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) by pointer doubling over (word, form); n grows along forms, so there is no cycle."""
    roots = forms.select("word", F.col("form").alias("root"))
    while True:
        up = roots.select(F.col("word").alias("root"), F.col("root").alias("up"))
        new = materialize(roots.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")))
        if new.where("moved").isEmpty():
            return new.select("word", "root")
        roots = new.select("word", "root")


def spelling_variants(words: DataFrame, factor: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of ``words`` (word, n; words are distinct).

    A word's form is its near word of largest n if that is at least ``factor`` times its own n.
    """
    pairs = near_pairs(words)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    counted = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = counted.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("neg"), "near")).alias("best"))
    strong = -F.col("best.neg") >= factor * F.col("n")
    linked = materialize(words.join(best, "word").select("word", "n_near", F.when(strong, F.col("best.near")).alias("form"),
                                                         F.when(strong, -F.col("best.neg")).alias("form_n")))
    roots = _roots(linked.where("form is not null"))
    out = words.join(linked, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
