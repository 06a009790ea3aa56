"""Spelling variants, fill-in-middle and adaptive quality rules against plain Python."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from riskframe.llm import adaptive_rules, infill, queries, variants

SF = "/root/testdata/sf0.001"


# --- spelling variants -------------------------------------------------------------------------

def plain_words(rows, least=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 6:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= least}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)):] == b[i + (len(b) >= len(a)):]


def plain_variants(words):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    best = {w: min(v, key=lambda x: (-words[x], x)) for w, v in near.items() if v}
    form = {w: x for w, x in best.items() if words[x] >= 5 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items())


def rows_of(df, *names):
    return sorted(tuple(r[c] for c in names) for r in df.collect())


VARIANT = ("word", "form", "root", "n", "n_near", "form_n")


def key(rows):
    return sorted(rows, key=lambda r: r[0])


@pytest.mark.parametrize("words", [
    {"colour": 100, "color1": 3, "colours": 20, "coloursx": 4, "xcolour": 20, "colou": 7, "colovr": 100, "clour": 1},
    {"aaaaaa": 50, "aaaaaaa": 10, "aaaaaaaa": 2, "aaaaab": 10, "baaaaa": 10, "abaaaa": 250},
    {"überall": 30, "überal": 6, "uberall": 6, "überallé": 5, "\U00010400berall": 6, "berall": 150, "abcdef": 9},
    {"abcdefg": 5, "abcdfeg": 5, "abcxefg": 25, "abcefg": 25, "abcdefgh": 25, "zabcdefg": 25, "abcdefz": 124, "qabcdefz": 625},
    {"abcdef": 1}, {},
])
def test_variants_equal_brute_force(spark, words):
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = [tuple(r[c] for c in VARIANT) for r in variants.spelling_variants(df).collect()]
    assert key(got) == plain_variants(words)


def test_near_pairs_of_random_words(spark):
    import random
    rnd = random.Random(5)
    words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(1, 9))) for _ in range(300)})
    got = variants.near_pairs(spark.createDataFrame([(w,) for w in words], "word string")).collect()
    pairs = [tuple(sorted((r["a"], r["b"]))) for r in got]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(a, b) for a in words for b in words if a < b and one_edit(a, b)}


def test_op11_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    got = [tuple(r[c] for c in VARIANT) for r in queries.op11_spelling_variants(spark, SF).collect()]
    words = plain_words(rows)
    want = plain_variants(words)
    assert any(r[1] for r in want) and key(got) == want


def test_words_of_awkward_documents(spark, docs, docs_rows, no_docs, clashing):
    want = plain_words([(r[0], r[1]) for r in docs_rows], 1)
    for d in (docs, clashing):
        assert {r["word"]: r["n"] for r in variants.corpus_words(d, least_count=1).collect()} == want
    assert variants.spelling_variants(variants.corpus_words(no_docs)).count() == 0


# --- fill in the middle ------------------------------------------------------------------------

def plain_infill(doc_id, text):
    t = text or ""
    s = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(s[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(t)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(m in t for m in infill.MARKERS) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, t
    if h[3] % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return doc_id, n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


AWKWARD = ["", None, "a", "\U0001F600", "\U0001F600" * 3000, "line\nline\r\n end", "has <P> in it", "<M>", "<P", "x<S", "$1\\1 ${a} \\", "é" * 2500,
           "<", "<<", "a<P<S<M", "\x00\x01", "ab" * 200_000, "é" * 700, "x" * 1024, "x" * 1025, "x" * 2048]


def test_fill_in_middle_equals_slicing_and_restores(spark):
    rows = [(i * 31 + j, t) for i, t in enumerate(AWKWARD) for j in range(12)] + [(None, "no id at all"), (7, "twice"), (7, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("form", F.lit(1))
    made = infill.fill_in_middle(df)
    got = made.withColumn("back", infill.restore(F.col("output"), F.col("form"))).collect()
    seen = Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in got)
    assert seen == Counter((*plain_infill(d, t), t or "") for d, t in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(df.limit(0)).count() == 0


def test_fill_in_middle_runs_without_python(spark, docs):
    plan = infill.fill_in_middle(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- adaptive rules ----------------------------------------------------------------------------

def plain_measures(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(lines), len(re.findall("[A-Z]", t)))


def bucket(v):
    extra = max(v.bit_length() - 7, 0)
    return v >> extra << extra


def plain_verdicts(rows):
    """rows: (doc_id, text, lang, source) -> {row number: (measures, base_failed, kept)}."""
    out, values, groups = [], {}, {}
    for i, (_, text, lang, source) in enumerate(rows):
        m = dict(zip(adaptive_rules.MEASURES, plain_measures(text), strict=True))
        failed = m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]
        values[i] = {name: r[2] * m[r[0]] // m[r[1]] if m[r[1]] else None for name, r in adaptive_rules.RULES.items()}
        out.append((tuple(m.values()), failed))
        if not failed:
            for g in ((lang, source), (lang,)):
                for name, v in values[i].items():
                    groups.setdefault((g, name), []).append(bucket(v))

    def ends(g, name):
        v = sorted(groups[g, name])
        q1, q3 = (v[-(-k * len(v) // 4) - 1] for k in (1, 3))
        spread = max(q3 - q1, adaptive_rules.RULES[name][3])
        return max(q1 - 3 * spread, 0), q3 + 3 * spread, len(v)

    result = []
    for i, ((_, _, lang, source), (m, failed)) in enumerate(zip(rows, out, strict=True)):
        kept = not failed
        if kept:
            for name, rule in adaptive_rules.RULES.items():
                own, wide = ends((lang, source), name), ends((lang,), name)
                low, high = ((own[2] * own[k] + adaptive_rules.PRIOR * wide[k]) // (own[2] + adaptive_rules.PRIOR) for k in (0, 1))
                kept &= values[i][name] <= high and not (rule[4] and values[i][name] < low)
        result.append((rows[i][0], *m, failed, kept))
    return result


RULED = ("doc_id", *adaptive_rules.MEASURES, "base_failed", "kept")


def test_op13_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    got = [tuple(r[c] for c in RULED) for r in queries.op13_quality_rules(spark, SF).collect()]
    want = plain_verdicts(rows)
    assert sorted(got) == sorted(want)
    assert any(not r[-1] and not r[-2] for r in want)


def test_rules_of_awkward_documents(spark, docs, docs_rows, no_docs, clashing):
    want = plain_verdicts([r[:4] for r in docs_rows])
    for d in (docs, clashing):
        got = Counter(tuple(r[c] for c in RULED) for r in adaptive_rules.judge_documents(d).collect())
        assert got == Counter(want)
    assert adaptive_rules.judge_documents(no_docs).count() == 0
    kept = adaptive_rules.kept_documents(clashing)
    assert kept.columns == clashing.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r[0] for r in want if r[-1])
    bare = adaptive_rules.judge_documents(docs.select("doc_id", "text"))
    assert bare.count() == len(docs_rows)


def test_sketches_merge_to_the_same_quantiles(spark):
    values = [v * v % 9973 for v in range(4000)]
    df = spark.createDataFrame([(str(v % 3), v) for v in values], "g string, value long")
    one = adaptive_rules.sketch(df.withColumn("all", F.lit(1)), ["all"])
    parts = adaptive_rules.merge(adaptive_rules.sketch(df, ["g"]).withColumn("all", F.lit(1)), ["all"])
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, parts.collect()))
    q = adaptive_rules.quartiles(one, ["all"]).first()
    exact = sorted(values)
    for name, k in (("q1", 1), ("q3", 3)):
        true = exact[k * len(values) // 4 - 1]
        assert q[name] <= true <= q[name] * (1 + 1 / 64) + 1
    assert one.count() < 64 * 14


def test_thresholds_follow_their_group(spark):
    code = " ".join(f"a{i} = b{i} & c{i} | d" for i in range(40))
    prose = " ".join(f"plain{w} words{w} number{w}" for w in "abcdefghijklmnopqrstuvwxyz")
    rows = [(i, f"{code} x{i}", "en", "code") for i in range(400)] + [(1000 + i, f"{prose} x{i}", "en", "prose") for i in range(400)]
    rows += [(5000, code, "en", "prose"), (5001, code, "en", "code")]
    kept = {r["doc_id"]: r["kept"] for r in adaptive_rules.judge_documents(
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert kept[5001] and not kept[5000] and kept[3] and kept[1003]
