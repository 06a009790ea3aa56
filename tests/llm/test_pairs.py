"""Jaccard join, fingerprints, nearest neighbours and packing against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from riskframe.llm import ann, fingerprints, jaccard, packing
from riskframe.llm.common import components
from riskframe.llm.shingles import shingle_sets
from riskframe.llm.tokens import TokenIds

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_groups(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def top(a):
        while parent[a] != a:
            a = parent[a]
        return a
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((top(a), top(b)))
                parent[q] = p
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize("k,percent,hot", [(4, 85, 1), (4, 85, 4), (5, 80, jaccard.HOT)])
def test_jaccard_groups_equal_brute_force(spark, k, percent, hot):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_groups(docs, k, percent, hot).collect()}
    assert got == brute_groups([tuple(r) for r in docs.collect()], k, percent)


def test_jaccard_groups_of_chained_near_copies(spark):
    """Members that reach each other only through others are one component."""
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        mine = list(words)
        for j in range(3 * i, 3 * i + 3):
            mine[j] = f"v{j}"
        words = mine
        rows.append((100 - i, " ".join(mine)))
    rows += [(i, " ".join(f"u{i}-{j}" for j in range(30)) + " " + " ".join(words[:20])) for i in range(200, 260)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_groups(docs, 4, 85).collect()}
    assert got == brute_groups(rows, 4, 85)


def test_jaccard_groups_of_awkward_rows(clashing, docs_rows, no_docs):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_groups(clashing, 4, 80).collect()), key=str)
    want = brute_groups([(r[0], r[1]) for r in docs_rows], 4, 80)
    n = len(shingles(docs_rows[0][1], 4))
    assert got == sorted([(r[0], *(want[r[0]] if r[0] is not None else (n, None))) for r in docs_rows], key=str)
    assert jaccard.jaccard_groups(no_docs).collect() == []


def test_shingle_names_do_not_depend_on_the_window(monkeypatch):
    import pyarrow as pa

    from riskframe.llm import shingles as module
    texts = pa.array(["a bb ccc dddd e", None, "", "x" * 500 + " y z w " + "q" * 300, "A BB CCC DDDD E", " lead and trail \n"])
    whole = [s.tolist() for s in shingle_sets(texts, 4)]
    monkeypatch.setattr(module, "WINDOW", 16)
    assert [s.tolist() for s in shingle_sets(texts, 4)] == whole
    assert whole[0] == whole[4] and [len(s) for s in whole] == [2, 0, 0, 2, 2, 1]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)], "src long, dst long")
    got = {r["node"]: r["label"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_fingerprints_follow_the_next_document(spark, clashing, docs_rows, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(docs).collect()}
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), reverse=True)
    by_text = {}
    for (i, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        want = text[:len(text) - len(text) // 3] + following[:len(text) // 3]
        assert got[i]["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest() and got[i]["n_chars"] == len(text)
        assert by_text.setdefault(text, got[i]["fingerprint"]) == got[i]["fingerprint"]
    near = np.array([(r["near_edited"], r["near_next"]) for r in got.values()])
    assert ((near >= 0) & (near <= 1)).all() and np.median(near[:, 0]) > 0.4 and np.median(near[:, 1]) < 0.1
    awkward = fingerprints.fingerprint_documents(clashing).collect()
    assert len(awkward) == len(docs_rows)
    assert {r["fingerprint"] for r in awkward if r["n_chars"] == 0} == {""}
    assert fingerprints.fingerprint_documents(no_docs).collect() == []
    one = fingerprints.fingerprint_documents(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()


def test_equal_substrings_share_interior_phrases():
    rng = np.random.default_rng(0)
    body = "".join(rng.choice(list("abcdefgh "), 4000))
    a, b, c = fingerprints.fingerprints(["qq" + body, "zzzzzzz" + body + "k", body[::-1]])
    assert fingerprints.likeness(a[None], b[None])[0] > 0.9 > 0.1 > fingerprints.likeness(a[None], c[None])[0]
    alone = [fingerprints.fingerprints([t])[0].tolist() for t in ("ab", "aaaa", body)]
    assert alone == [p.tolist() for p in fingerprints.fingerprints(["ab", "aaaa", body])]


def recall(rows, got, every, k):
    ids, m = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    by = {}
    for r in got.collect():
        by.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = total = 0
    for i in ids[ids % every == 0]:
        s = m @ m[i]
        s[i] = -np.inf
        hits, total = hits + len(set(ids[np.lexsort((ids, -s))[:k]].tolist()) & by[i]), total + k
    return hits / total


def unequal(n=3000, dim=24):
    """Random vectors whose norms differ much."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(n, dim)) * rng.lognormal(0, 1.5, size=(n, 1))
    return [(i, x.tolist()) for i, x in enumerate(v)]


def test_nearest_of_vectors_of_unequal_norm(spark):
    rows = unequal()
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=20, k=10)
    assert recall(rows, got, 20, 10) >= 0.9


def test_nearest_is_exact_where_the_cap_binds(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(6000, 24)))]
    monkeypatch.setattr(ann, "MOST_PROBES", 4)
    monkeypatch.setattr(ann, "SHARE", 100)  # several parts of the queries
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=20, k=10)
    assert recall(rows, got, 20, 10) == 1.0


def test_nearest_of_a_tight_cluster_is_split(spark, monkeypatch, tmp_path):
    """A third of the rows near-equal: no task holds them all, and queries still find their neighbours."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(6000, 24))
    v[::3] = v[0] + 1e-4 * rng.normal(size=(2000, 24))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    monkeypatch.setattr(ann, "SHARE", 400)
    monkeypatch.setattr(ann, "PIECE", 50, raising=False)
    reranked, sizes = ann._rerank, str(tmp_path)

    def rerank(left, right, k, everything):
        import os
        import uuid
        with open(os.path.join(sizes, uuid.uuid4().hex), "w") as f:
            f.write(str(right.num_rows))
        return reranked(left, right, k, everything)

    monkeypatch.setattr(ann, "_rerank", rerank)
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=20, k=10)
    assert recall(rows, got, 20, 10) >= 0.9
    largest = max(int(f.read_text()) for f in tmp_path.iterdir())
    assert 0 < largest < 1000, largest


def test_pieces_of_a_cell_are_even_and_all_visited():
    large, counts = np.array([7, 2 ** 40]), np.array([3, 16])
    ids = np.arange(0, 640_000, 20)
    salts = ann._salts(np.full(len(ids), 2 ** 40), ids, large, counts)
    shares = np.bincount(ann._share(np.full(len(ids), 2 ** 40), 0, 16, salts))
    assert len(shares) == 16 and shares.max() < 2 * len(ids) / 16
    cells, pieces = ann._all_salts(np.array([5, 2 ** 40, 7]), large, counts)
    assert list(zip(cells, pieces)) == [(5, 0), *((2 ** 40, i) for i in range(16)), *((7, i) for i in range(3))]


def test_nearest_reaches_recall_and_awkward_vectors(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in e.collect()}
    ids = np.array(sorted(x))
    m = np.stack([x[i] for i in ids])
    got = {}
    for r in ann.nearest(e).collect():
        assert abs(r["score"] - float(x[r["query_id"]] @ x[r["vec_id"]])) < 1e-12
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        s = m @ x[q]
        s[ids == q] = -np.inf
        want = ids[np.lexsort((ids, -s))[:20]]
        assert sorted(got[q]) == list(range(1, 21))
        hits, total = hits + len(set(want) & set(got[q].values())), total + 20
    assert hits / total >= 0.9
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]),
            (6, [float("inf"), 1.0]), (None, [1.0, 1.0]), (8, [1.0]), (9, [3.0, -1.0])] + [(10 + i, [1.0, 0.0]) for i in range(40)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    by = {}
    for r in ann.nearest(v, every=20, k=20).collect():
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert sorted(by) == [0, 20, 40] and [i for _, i in sorted(by[0])] == [9, *range(10, 29)]
    assert [i for _, i in sorted(by[20])] == [9, 0, *[i for i in range(10, 29) if i != 20]]
    assert ann.nearest(v.where("vec_id < 0")).collect() == []
    few = ann.nearest(v.where("vec_id in (0, 1, 9)")).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(few, key=lambda r: r["rank"])] == [(1, 9), (2, 1)]


def check_packing(rows, bound):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert bound <= len(by)
    return len(by)


def test_packing_round_trip_and_bound(spark, clashing, no_docs):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(VOCABULARY)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pieces = packing.token_pieces(docs, VOCABULARY)
    packed = packing.pack(pieces)
    rows = packed.collect()
    assert check_packing(rows, packing.packing_bound(packed)) <= packing.packing_bound(packed) + 1
    own = {}
    for r in rows:
        own.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for r in docs.collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        assert sorted(own[r["doc_id"]]) == [(k, s, len(ids[s:s + 4096]), zlib.crc32(np.array(ids[s:s + 4096], "<u4").tobytes()))
                                            for k, s in enumerate(range(0, len(ids), 4096))]
    # many small shares that exchange what they leave open
    exchanged = packing.pack(pieces, pool=60, share=10).collect()
    assert check_packing(exchanged, packing.packing_bound(packed)) <= packing.packing_bound(packed) + 4
    awkward = packing.pack(packing.token_pieces(clashing, VOCABULARY)).collect()
    check_packing(awkward, 0)
    assert sum(r["piece"] == 0 for r in awkward) == clashing.count()
    assert packing.pack(packing.token_pieces(no_docs, VOCABULARY)).collect() == []


def test_lower_bound_and_best_fit():
    lengths = np.array([60, 60, 60, 41, 41, 39, 39, 20, 1])
    assert packing.lower_bound(np.bincount(lengths, minlength=101), 100) == 4
    bins, offsets, free = packing.best_fit(lengths, 100)
    assert [int(lengths[bins == b].sum()) for b in range(len(free))] == [100 - f for f in free]
    big = np.array([51] * 7 + [3] * 5)
    assert packing.lower_bound(np.bincount(big, minlength=101), 100) == 7


@pytest.mark.parametrize("text", ["Plain words, here.", "It's 12 o'clock!!", "ÀÉÎ ñandú straße", "ﬁne ΟΔΟΣ İstanbul", "é Å", "a\x1cb c\x85d\xa0e", "日本語 текст", "don't''s <|endoftext|> _x_", "", " \n", "<|endoftext|>", "a<|startoftext|>b <|endoftext|><|endoftext|> c", "<|EndOfText|> <| endoftext |>", "x\n<|startoftext|>\n"])
def test_token_ids_equal_the_tokenizer(text):
    from tokenizers import Tokenizer

    from riskframe.llm.tokens import TokenIds
    tokenizer = Tokenizer.from_file(VOCABULARY)
    ids = TokenIds(VOCABULARY)
    for _ in range(2):
        assert np.frombuffer(ids.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_token_ids_of_random_characters_equal_the_tokenizer():
    """Contractions, digits, odd white space, special literals and characters of the simple blocks in random order."""
    ids, rnd = TokenIds(VOCABULARY), random.Random(5)
    parts = ["don't", "I'LL", "'re", "'S", "_a_", "9'd", "÷2", "ŉ", "ſt", "<|endoftext|>", "中文", "\x85", "\xa0", "İ", *"ab 1'_.-\n\t"]
    for i in range(4000):
        text = "".join(rnd.choice(parts if i % 2 else [chr(c) for c in range(0x180)]) for _ in range(rnd.randrange(1, 30)))
        want = ids.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids.ids(text), "<u4").tolist() == want, repr(text)


def test_fingerprints_of_an_id_of_many_rows(spark):
    """Rows of one id, and rows without one, are spread over buckets; every row is followed by the next."""
    rows = [(7, f"text {i % 150} of the hot id") for i in range(300)] + [(None, f"no id {i}") for i in range(200)] + [(i, f"own {i}") for i in range(20, 40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = fingerprints.fingerprint_documents(frame).select("doc_id", "edited_sha256").collect()
    names = frame.selectExpr("doc_id", "text", "xxhash64(text) h").collect()
    order = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["h"], r["text"]) for r in names), reverse=True)
    want = []
    for (known, doc, _, text), (*_, following) in zip(order, order[1:] + order[:1], strict=True):
        want.append((doc if known else None, hashlib.sha256(fingerprints.edited(text, following).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_buckets_divide_hot_ids_and_keep_the_order():
    import pandas as pd
    rng = np.random.default_rng(3)
    ids = pd.Series([None] * 300 + [5] * 400 + rng.integers(-50, 50, 300).tolist(), dtype="Int64")
    h = pd.Series(rng.integers(-2 ** 63, 2 ** 63 - 1, 1000))
    known = np.sort(ids.dropna().to_numpy(np.int64))
    cuts = known[np.linspace(0, len(known), 20, endpoint=False).astype(int)[1:]].tolist()
    at = fingerprints.Buckets(cuts, 6).of(ids, h)
    assert np.bincount(at).max() < 120
    order = sorted(range(1000), key=lambda i: (not pd.isna(ids[i]), 0 if pd.isna(ids[i]) else ids[i], h[i]))
    assert (np.diff(at[order]) >= 0).all()
    top = np.iinfo(np.int64).max
    assert fingerprints.Buckets([top, top], 0).of(pd.Series([top, 0], dtype="Int64"), pd.Series([-2 ** 63, 0])).tolist() == [2, 1]
