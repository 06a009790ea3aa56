"""Edge cases of single texts: bad markup, long secrets, glued sentences, long clean texts, even shards."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.llm import html_text, mixing, pii, toxicity


@pytest.mark.parametrize("html,text", [
    ("<p>a</p><![foo[bar]]>x", "a x"), ("<![ x", ""), ("<p>A <!-- c", "A"), ("<p>A <!-- c --> b</p>", "A b"), ("<![CDATA[ no ]]><p>yes</p>", "yes"),
    ("<p>x</p><a href=\"", "x"), ("<p>a < b & c</p>", "a < b & c"), ("<p>x<!doctype", "x"), ("<![if IE]><p>a</p><![endif]>", "a"),
    ("<div id='share-of-market'><p>Shares rose.</p></div>", "Shares rose."), ("<p>t</p><div class='cookie-banner'>x</div>", "t"),
    ("<p>t</p><div class='Sidebar left'>x</div>", "t"), ("<p>t</p><div id='social_links-2'>x</div>", "t"), ("<div class='adjacent'>kept</div>", "kept")])
def test_main_text_of_bad_markup(html, text):
    assert html_text.main_text(html) == text


def test_no_page_fails_its_run(spark):
    pages = [(i, "u", h) for i, h in enumerate(["<![", "<!", "</", "<![ [ >", "<!-", "<!--", "<!-->", "<?", "<![x", "&#", "&#x;", "<a <b", "<p>fine</p>"])]
    got = html_text.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(got) == len(pages) and got[-1]["text"] == "fine"


def test_secrets_of_any_length_are_found_whole():
    value = "x9" * 5_000
    assert pii.loose_spans(f"password = {value} end") == [("secret", 11, 11 + len(value))]
    assert ("secret", 4, 7 + len(value)) in pii.loose_spans(f"the sk-{value} key")


def test_many_spans_take_linear_time():
    def seconds(n):
        text = " ".join(f"joe{i}@mail.com call 555-123-{i % 9000 + 1000}" for i in range(n))
        at = time.perf_counter()
        base, loose = pii._candidates(text)
        assert len(base) == len(loose) == n
        return time.perf_counter() - at

    seconds(100)
    assert seconds(16_000) < 24 * max(seconds(2_000), 0.01)


def test_loose_spans_never_overlap_base_spans():
    text = "token=joe@mail.example.com +1 555-123-4567 x 555-123-4567 password: 4111 1111 1111 1111 secret=abc123def"
    base, loose = pii._candidates(text)
    assert loose and all(e <= a or b <= s for _, s, e in loose for _, a, b in base)


def test_length_and_glue_of_sentences(spark):
    rows = [(i, f"calm words here number {i}. more calm words" if i % 2 else f"calm words here {i}. you idiot", i % 2) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9001, "calm words. " * 40_000), (9002, "fine.idiot!words"), (9003, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert got[9001]["predicted"] == 0 and got[9002]["predicted"] == 1 and got[9003]["score"] == 0
    span = got[9002]["offending"][0]
    assert "fine.idiot!words"[span["start"]:span["end"]] == "idiot!"


def test_mix_partitions_are_even_and_shards_follow_the_words(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 20_000)
    monkeypatch.setattr(mixing, "PART_WORDS", 5_000)
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"),
                                      (F.col("id") % 37).alias("size"))
    mixed = mixing.mixed_rows(docs, block=50)
    rows = mixed.withColumn("part", F.spark_partition_id()).groupBy("part", "shard").agg(F.sum("size").alias("words")).collect()
    assert len({r["shard"] for r in rows}) == 27  # 1.5 x 359,990 words
    per = np.array([r["words"] for r in rows])
    assert len(per) == 27 * 4 and per.max() < 2 * np.median(per)
    drawn = mixing.mix(docs, block=50).select(F.sum(F.col("size") * F.size("draws")).alias("n")).first()["n"]
    assert drawn == per.sum() and abs(drawn - 1.5 * 359_990) < 2_000
