"""The operators of this package as registered queries over the whole driver tables.

Each query calls its operator with production parameters and derives the digest columns of its
contract from the operator's own output.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from ..session import read_table
from . import adaptive_rules, ann, fingerprints, html_text, infill, jaccard, mixing, packing, pii, quality, toxicity, url_rules, variants
from .common import materialize

#: Token vocabulary of packing: a file that every executor can read under this path.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_quality(spark, sf_dir):
    return quality.score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_personal_data(spark, sf_dir):
    found = pii.find_personal_data(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    named = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in pii.BASE], F.sha2(named(base), 256).alias("base_sha256"), named("spans").alias("spans"))


def op3_packing(spark, sf_dir):
    return packing.pack(packing.token_pieces(read_table(spark, sf_dir, "documents"), VOCABULARY))


def op4_main_text(spark, sf_dir):
    return html_text.extract_text(read_table(spark, sf_dir, "pages"))


def op5_mixing(spark, sf_dir):
    sizes = materialize(mixing.with_sizes(read_table(spark, sf_dir, "documents")).select("doc_id", "source", "size"))
    return mixing.mix(sizes).select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"))


def op6_toxicity(spark, sf_dir):
    docs, labels = read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels")
    return toxicity.score_toxicity(docs, labels).select("doc_id", "held_out", "score", "predicted", F.size("offending").alias("n_offending"))


def op7_nearest(spark, sf_dir):
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op8_fingerprints(spark, sf_dir):
    return fingerprints.fingerprint_documents(read_table(spark, sf_dir, "documents"))


def op9_url_rules(spark, sf_dir):
    return url_rules.judge_urls(read_table(spark, sf_dir, "pages").select("page_id", "url"))


def op10_jaccard(spark, sf_dir):
    return jaccard.jaccard_groups(read_table(spark, sf_dir, "documents"), words=4, percent=85)


def op11_spelling_variants(spark, sf_dir):
    return variants.spelling_variants(materialize(variants.corpus_words(read_table(spark, sf_dir, "documents"))))


def op12_fill_in_middle(spark, sf_dir):
    made = infill.fill_in_middle(read_table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
                       digest(infill.restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op13_quality_rules(spark, sf_dir):
    return adaptive_rules.judge_documents(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality": (op1_quality, None),
    "op2_personal_data": (op2_personal_data, None),
    "op3_packing": (op3_packing, None),
    "op4_main_text": (op4_main_text, None),
    "op5_mixing": (op5_mixing, None),
    "op6_toxicity": (op6_toxicity, None),
    "op7_nearest": (op7_nearest, None),
    "op8_fingerprints": (op8_fingerprints, None),
    "op9_url_rules": (op9_url_rules, url_rules.oracle()),
    "op10_jaccard": (op10_jaccard, None),
    "op11_spelling_variants": (op11_spelling_variants, None),
    "op12_fill_in_middle": (op12_fill_in_middle, infill.oracle()),
    "op13_quality_rules": (op13_quality_rules, adaptive_rules.oracle()),
}
