"""Quality, toxicity, personal data, page text, url rules, mixing and the pipeline."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from riskframe.llm import html_text, mixing, pii, quality, toxicity, url_rules

SF = "/root/testdata/sf0.01"


def held_out(scored, labels, label):
    y = {r["doc_id"]: r[label] for r in labels.collect()}
    rows = [(r["score"], r["predicted"], y[r["doc_id"]]) for r in scored.collect() if r["held_out"] and y.get(r["doc_id"]) is not None]
    return np.array(rows)


def auc(rows):
    pos, neg = rows[rows[:, 2] == 1, 0], rows[rows[:, 2] == 0, 0]
    return np.mean([(p > neg).mean() + (p == neg).mean() / 2 for p in pos])


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = held_out(quality.score_quality(spark.read.parquet(f"{SF}/documents.parquet"), labels), labels, "quality")
    assert auc(rows) > 0.95 and (rows[rows[:, 2] == 1, 1] == 1).mean() > 0.97


def test_toxicity_held_out_and_sentences(spark):
    # sf0.01 has 45 toxic documents to learn from, some of them labelled at random
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    scored = toxicity.score_toxicity(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), labels)
    rows = held_out(scored, labels, "toxic")
    clean, toxic = rows[rows[:, 2] == 0], rows[rows[:, 2] == 1]
    assert auc(rows) > 0.95 and (clean[:, 1] == 0).mean() > 0.98 and (toxic[:, 1] == 1).mean() > 0.8
    hit = scored.where("lang = 'en' and predicted = 1 and size(offending) > 0").limit(5).collect()
    assert hit and all(r["text"][s["start"]:s["end"]].strip() for r in hit for s in r["offending"])


def test_noisy_or_learns_words_from_document_labels():
    hits = [[[0]], [[0], [1]], [[1]], [], [[1], [1]], [[0, 1]]]
    weights, bias = toxicity.learn(hits, np.array([1, 1, 0, 0, 0, 1]), 2)
    assert weights[0] + bias > 0 > weights[1] + bias and bias < -3


@pytest.mark.parametrize("score", [lambda d, y: quality.score_quality(d, y), lambda d, y: toxicity.score_toxicity(d, y)])
def test_scores_of_awkward_rows(score, clashing, no_docs, labels, spark):
    rows = score(clashing, labels).collect()
    assert len(rows) == clashing.count() and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [False]
    assert len({r["score"] for r in rows if r["doc_id"] == 2}) == 1
    assert score(no_docs, labels).collect() == []
    assert len(score(clashing, labels.where("doc_id < 0")).collect()) == clashing.count()


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP, CARD = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_base(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        doubled = sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits)))
        if 13 <= len(digits) <= 19 and doubled % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_base_spans_equal_brute_force():
    rng = random.Random(5)
    texts = ["".join(rng.choices("0123456789.-+ ()@aB_%x\n", k=rng.randint(0, 60))) for _ in range(20_000)]
    texts += ["4111 1111 1111 1111", "+1 (555) 010-9999 x", "1.2.3.4.5.6.7.8", "300.1.1.1", "a@b.co@c.de", "ü@x.com"]
    assert all(pii.base_spans(t) == brute_base(t) for t in texts)


def test_personal_data_spans_and_redaction(spark, clashing, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for r in pii.find_personal_data(docs).select("text", "spans").collect():
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]] == brute_base(r["text"])
    cut = {r["doc_id"]: r for r in pii.redact(clashing.drop("spans")).collect()}
    assert cut[10]["text"] == "mail me at <email> now" and cut[10]["n_chars"] == len(cut[10]["text"]) and cut[4]["text"] is None
    assert pii.find_personal_data(no_docs).collect() == []
    assert len(pii.find_personal_data(clashing).collect()) == clashing.count()


def test_reliabilities_find_the_noisy_labeler():
    rng = np.random.default_rng(2)
    truth = rng.random(4000) < 0.5
    votes = np.stack([np.where(rng.random(4000) < p, truth, ~truth) * 2 - 1 for p in (0.95, 0.9, 0.9, 0.5, 0.85)], 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    p = {tuple(v): x for v, x in zip(patterns, pii.reliabilities(patterns, counts.astype(float)), strict=True)}
    assert np.mean([(p[tuple(v)] >= 0.5) == t for v, t in zip(votes, truth, strict=True)]) > 0.95
    assert p[(1, 1, 1, -1, 1)] > 0.99


PAGES = [
    ("<html><body><nav><a href=/>Home</a></nav><article><h1>Title &amp; more</h1><p>First <b>bold<br><p>Second\n  part</p><aside>Ad text</aside>"
     "<div class='comments'><p>I disagree</p></div></article><footer>&copy; us</footer>", "Title & more First bold Second part"),
    ("<div id=cookie-notice>We use cookies</div><main><p>Only this.</p><form>Sign up <input></form></main><script>var x='<p>no</p>';</script>", "Only this."),
    ("<p>Plain page without any region that is long enough to stand out.</p><p>And a second paragraph of it.</p>",
     "Plain page without any region that is long enough to stand out. And a second paragraph of it."),
    ("just text", "just text"), ("", ""), (None, ""), ("<article></article>", ""), ("</p></div><p>stray", "stray"),
]


@pytest.mark.parametrize("html,want", PAGES)
def test_main_text(html, want):
    assert html_text.main_text(html) == want


@pytest.mark.parametrize("inside,want", [
    ("<p>Before <script>x</script> after</p>", "Before after"),
    ("<p>a <b>b</b>, <a href=/>c</a>.</p>", "a b, c."),
    ("<p>Before <svg><title>icon</title><path d=M0 /></svg> after</p><p>Next</p>", "Before after Next"),
    ("<p>Before <span class=ad>Buy <b>now</b></span>after <a class=share>Share</a>end</p>", "Before after end"),
    ("<p>Before <select><option>one<option>two</select> after</p>", "Before after"),
    ("<p>Before <noscript><p>Enable<div>scripts</div></noscript> after</p>", "Before after"),
    ("<p>Before <button><div>Press</div></button> after</p>", "Before after"),
    ("<p>Before <iframe>no</iframe><style>p {}</style>after<p>Next <a class=share>Share<p>Last", "Before after Next Last"),
    ("<p>un<b>bro</b>ken</p><div class=ad><p>Buy</p></div>tail", "unbroken tail")])
def test_main_text_keeps_lines_with_inline_elements(inside, want):
    assert html_text.main_text(f"<body><nav><a href=/>Home</a></nav><article>{inside}</article></body>") == want
    assert html_text.main_text(f"<body>{inside}</body>") == want


def test_inline_elements_count_as_tags_of_their_line():
    parser = html_text._Lines()
    parser.feed("<p>a <b>b</b>, c <script>x</script><svg><path /></svg></p><p>d</p>")
    parser.close()
    assert parser.lines == [("a b, c", 3, 0), ("d", 1, 0)]


def test_page_text_of_the_tables(spark):
    import html as entities
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in html_text.extract_text(pages).drop("url").join(pages, "page_id").collect():
        inside = re.sub(r"</?(p|h1|br)>", " ", r["html"][r["html"].index("<article>"):r["html"].index("</article>")])
        assert r["text"] == " ".join(entities.unescape(re.sub(r"<[^>]+>", "", inside)).split()) and r["n_chars"] == len(r["text"])
    assert html_text.extract_text(pages.limit(0)).collect() == []


def test_url_rules_equal_sql(spark):
    rows = [(1, "http://example.com/en/x"), (2, "https://WWW.Example.com/en/?q"), (3, "https://www.example.com"), (4, "ftp://a.net/es/"), (5, None),
            (6, "nothing"), (7, "http://notexample.com/en/"), (8, "http://com/"), (9, "http://x.net/esx/"), (10, "http://casino-win.example.org/a#b"),
            (11, "http://://x"), (12, "http://a.net/fr/ñ"), (13, "http://ads.example.org:80/en/"), (1, "http://example.com/en/x"), (None, "http://b.net/es/1"),
            (14, "http://example.com/EN/x"), (15, "http://x.example.com/en/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as host", "2 as rule", "3 as token")
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    want = sorted(con.execute(url_rules.oracle()).fetchall(), key=str)
    got = url_rules.judge_urls(pages)
    assert sorted(map(tuple, got.select("page_id", "host", "path", "rule", "verdict").collect()), key=str) == want
    assert dict((r[0], r[4]) for r in want) | {1: "block", 2: "allow", 3: "allow", 4: "block", 10: "block"} == dict((r[0], r[4]) for r in want)
    assert url_rules.judge_urls(pages.limit(0)).collect() == []


def brute_targets(sizes, share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(names)}
    full, total = {}, share * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        level = (total - sum(full.values())) / (sum(weight[s] for s in rest) or 1)
        over = [s for s in rest if level * weight[s] > most * sizes[s]]
        if not over:
            return full | {s: level * weight[s] for s in rest}
        full |= {s: most * sizes[s] for s in over}


def test_mixing_targets_and_takes(spark, clashing, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sized = mixing.with_sizes(docs).select("doc_id", "text", "source", "size")
    rows = mixing.mix(sized, block=20, shards=8).collect()
    assert len(rows) == docs.count()
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) and len(r["draws"]) <= 2
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * len(r["draws"])
        target[r["source"]] = r["target"]
    want = brute_targets(sizes)
    assert all(abs(target[s] - want[s]) < 1e-6 * want[s] and abs(taken[s] - want[s]) < 0.02 * want[s] for s in sizes)
    again = mixing.mix(sized.repartition(5), block=20, shards=8).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    awkward = mixing.mix(mixing.with_sizes(clashing.drop("size", "row", "block"))).collect()
    assert len(awkward) == clashing.count() and all(len(r["draws"]) <= 2 for r in awkward)
    assert mixing.mix(mixing.with_sizes(no_docs)).collect() == []
    mixed = mixing.mixed_rows(sized, shards=8, block=20)
    assert mixed.count() == sum(len(r["draws"]) for r in rows)


def test_splitting_tree_keeps_quotas():
    quotas = np.array([100, 0, 7, 1])
    parts = mixing.split_quotas(quotas, 6, 1)
    assert (parts.sum(0) == quotas).all() and (parts >= 0).all() and parts.sum(1).max() - parts.sum(1).min() <= 2
    assert (parts == mixing.split_quotas(quotas, 6, 1)).all()


def test_pipeline_stages(spark, docs, labels, tmp_path):
    import corpus_pipeline as P
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    out = docs
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, out, str(tmp_path))
        assert out.columns == docs.columns, name
    kept = P.drop_near_duplicates(spark, docs, str(tmp_path)).collect()
    ids = [r["doc_id"] for r in kept]
    assert sorted(i for i in ids if i is not None) == [1, 4, 5, 6, 7, 9, 10, 11] and ids.count(None) == 1
    assert P.pack_sequences(spark, out, str(tmp_path)).count() > 0
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        empty = stage(spark, empty, str(tmp_path))
    assert empty.collect() == []
