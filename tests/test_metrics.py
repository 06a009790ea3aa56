import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import drift as D
from riskframe.operators import metrics as M

LABS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]


def _f1s(truth, pred, labels):
    out = {}
    for l in labels:
        tp = sum(1 for t, p in zip(truth, pred) if t == l and p == l)
        fp = sum(1 for t, p in zip(truth, pred) if t != l and p == l)
        fn = sum(1 for t, p in zip(truth, pred) if t == l and p != l)
        prec = tp / (tp + fp) if tp + fp else 0.0
        rec = tp / (tp + fn) if tp + fn else 0.0
        f1 = 2 * tp / (2 * tp + fp + fn) if (2 * tp + fp + fn) else 0.0
        out[l] = (prec, rec, f1, tp + fn)
    return out


def test_confusion_and_macro_f1_trap9(spark):
    rnd = random.Random(1)
    truth = [rnd.choice(LABS[:3]) for _ in range(300)]          # CRITICAL never in truth
    pred = [rnd.choice(LABS[:2]) for _ in range(300)]           # nor in predictions
    df = spark.createDataFrame(list(zip(truth, pred)), "t string, p string")
    cm = M.confusion_matrix(df, "t", "p")
    assert cm.count() == 16 and cm.where("n = 0").count() >= 7
    s = M.summary(cm).first()
    ref = _f1s(truth, pred, LABS)
    present = [l for l in LABS if l in set(truth) | set(pred)]
    assert s.macro_f1 == pytest.approx(np.mean([ref[l][2] for l in present]))
    assert s.macro_f1_all == pytest.approx(np.mean([ref[l][2] for l in LABS]))
    assert s.balanced_accuracy == pytest.approx(np.mean([ref[l][1] for l in LABS if l in set(truth)]))
    sup = sum(ref[l][3] for l in LABS)
    assert s.weighted_f1 == pytest.approx(sum(ref[l][2] * ref[l][3] for l in LABS) / sup)
    assert s.critical_recall == 0.0


def test_ece_edges_trap10(spark):
    conf = [1.0, 1.0, 0.6, 0.3, 0.95, 0.0]
    corr = [1, 1, 0, 1, 1, 0]
    df = spark.createDataFrame(list(zip(conf, corr)), "c double, a int")
    got = M.ece(df, "c", "a").first()[0]
    bins = np.linspace(0, 1, 11)
    c, a = np.array(conf), np.array(corr, dtype=float)
    ref = 0.0
    for i in range(10):
        m = (c >= bins[i]) & (c < bins[i + 1])
        if m.sum():
            ref += m.sum() / len(c) * abs(a[m].mean() - c[m].mean())
    assert got == pytest.approx(ref)
    # 0.6 falls in [0.5, 0.6000000000000001), not in the 0.6 bin
    assert df.select(M.ece_bin(F.col("c"))).collect()[2][0] == 5
    assert df.select(M.ece_bin(F.col("c"))).collect()[0][0] is None


def _auc_brute(scores, labels):
    pos = [s for s, y in zip(scores, labels) if y == 1]
    neg = [s for s, y in zip(scores, labels) if y == 0]
    tot = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_auc_matches_pairwise_with_ties(spark):
    rnd = random.Random(7)
    rows = [(round(rnd.random(), 2), int(rnd.random() < 0.3), rnd.choice("ab")) for _ in range(800)]
    df = spark.createDataFrame(rows, "s double, y int, g string")
    got = {r.g: r.roc_auc for r in M.auc(df, "s", "y", by=["g"]).collect()}
    for g in "ab":
        sub = [(s, y) for s, y, gg in rows if gg == g]
        assert got[g] == pytest.approx(_auc_brute([s for s, _ in sub], [y for _, y in sub]))
    one = spark.createDataFrame([(0.1, 1), (0.2, 1)], "s double, y int")
    assert M.auc(one, "s", "y").first()[0] == 0.5


def _psi_numpy(ref, cur):
    bins = np.unique(np.percentile(ref, np.linspace(0, 100, 11)))
    if len(bins) < 2:
        return 0.0
    bins[0], bins[-1] = -np.inf, np.inf
    r, _ = np.histogram(ref, bins=bins)
    c, _ = np.histogram(cur, bins=bins)
    rp = np.where(r == 0, 0.0001, r) / len(ref)
    cp = np.where(c == 0, 0.0001, c) / len(cur)
    return float(np.sum((cp - rp) * np.log(cp / rp)))


def _ks_numpy(a, b):
    x = np.sort(np.concatenate([a, b]))
    fa = np.searchsorted(np.sort(a), x, side="right") / len(a)
    fb = np.searchsorted(np.sort(b), x, side="right") / len(b)
    return float(np.max(np.abs(fa - fb)))


def test_psi_ks_moments_match_numpy_including_flag_trap12(spark):
    rng = np.random.default_rng(3)
    ref = {"x": rng.normal(0, 1, 600).round(3), "flag": (rng.random(600) < 0.3).astype(float),
           "const": np.ones(600)}
    cur = {"x": rng.normal(0.4, 1.2, 500).round(3), "flag": (rng.random(500) < 0.35).astype(float),
           "const": np.ones(500)}
    mk = lambda d: spark.createDataFrame([tuple(float(d[k][i]) for k in ("x", "flag", "const"))
                                          for i in range(len(d["x"]))], "x double, flag double, const double")
    long = D.unpivot(mk(ref), mk(cur), ["x", "flag", "const"])
    psi = {r.feature: r.psi for r in D.psi(long).collect()}
    ks = {r.feature: r.ks_statistic for r in D.ks(long).collect()}
    mo = {r.feature: r for r in D.moments(long).collect()}
    for f in ("x", "flag", "const"):
        assert psi[f] == pytest.approx(_psi_numpy(ref[f], cur[f]), abs=1e-12)
        assert ks[f] == pytest.approx(_ks_numpy(ref[f], cur[f]), abs=1e-12)
        assert mo[f].ref_std == pytest.approx(float(np.std(ref[f])))
    assert psi["const"] == 0.0


def test_chi_square_and_pvalues(spark):
    ref = ["a"] * 50 + ["b"] * 30 + ["c"] * 20
    cur = ["a"] * 20 + ["b"] * 30 + ["d"] * 10
    df_r = spark.createDataFrame([(x,) for x in ref], "cat string")
    df_c = spark.createDataFrame([(x,) for x in cur], "cat string")
    long = D.unpivot(df_r, df_c, ["cat"], kind="string")
    r = D.categorical_report(long).first()
    cats = sorted(set(ref) | set(cur))
    rf = [ref.count(c) + 1 for c in cats]
    cf = [cur.count(c) + 1 for c in cats]
    exp = [f * sum(cf) / sum(rf) for f in rf]
    stat = sum((o - e) ** 2 / e for o, e in zip(cf, exp))
    assert r.statistic == pytest.approx(stat)
    # chi-square survival for dof 3 has a closed form
    x, k = stat, 3
    sf = math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    assert r.p_value == pytest.approx(sf, rel=1e-9)
    assert D._gammaincc(2.0, 3.7004692680571822 / 2) == pytest.approx(math.exp(-1.85023463) * (1 + 1.85023463), rel=1e-8)


def test_ks_pvalue_shift_and_same(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(0, 1, 500)
    b = rng.normal(3, 1, 500)
    mk = lambda v: spark.createDataFrame([(float(x),) for x in v], "v double")
    rep = {r.feature: r for r in D.numeric_report(D.unpivot(mk(a), mk(b), ["v"])).collect()}
    assert rep["v"].drift_detected and rep["v"].p_value < 1e-6 and rep["v"].psi > 0.25
    same = D.numeric_report(D.unpivot(mk(a), mk(a), ["v"])).first()
    assert same.psi < 0.05 and not same.drift_detected and same.p_value > 0.99


def test_centroid_distance(spark):
    a = [[1.0, 0.0, 2.0], [3.0, 1.0, 0.0]]
    b = [[0.0, 1.0, 1.0], [0.0, 3.0, None]]
    ra = spark.createDataFrame([(x,) for x in a], "e array<double>")
    rb = spark.createDataFrame([(x,) for x in b], "e array<double>")
    got = D.centroid_distance(ra, rb, "e").first()
    ma = np.mean(np.array(a), axis=0)
    mb = np.mean(np.array([[0, 1, 1], [0, 3, 0]], dtype=float), axis=0)
    ref = 1 - ma @ mb / (np.linalg.norm(ma) * np.linalg.norm(mb))
    assert got.cosine_distance_raw == pytest.approx(ref) and got.cosine_distance == round(ref, 4)


def test_realised_accuracy_d30_threshold_and_keyed_pairs(spark):
    from riskframe.operators import joins as J
    rnd = random.Random(7)
    ids = [f"CVE-{i}" for i in range(40)]
    truth = {i: rnd.choice(LABS) for i in ids}
    pred = {i: rnd.choice(LABS) for i in ids}
    # predictions arrive in a different order than the labels: pairing is by key
    p = spark.createDataFrame([("a" if n < 25 else "b", i, pred[i]) for n, i in enumerate(reversed(ids))],
                              "model_version string, cve_id string, prediction string")
    t = spark.createDataFrame([(i, truth[i]) for i in ids], "cve_id string, base_severity string")
    j = J.late_label_join(p, t)
    cm = M.confusion_matrix(j, "truth", "predicted", by=["model_version"])
    rows = {r.model_version: r for r in M.realised_accuracy(cm, ["model_version"]).collect()}
    assert set(rows) == {"a"}                      # version b has 15 < 20 pairs: no result
    a_ids = list(reversed(ids))[:25]
    ref = _f1s([truth[i] for i in a_ids], [pred[i] for i in a_ids], LABS)
    present = [l for l in LABS if l in {truth[i] for i in a_ids} | {pred[i] for i in a_ids}]
    assert rows["a"].evaluated_samples == 25
    assert rows["a"].macro_f1 == pytest.approx(np.mean([ref[l][2] for l in present]))
    assert rows["a"].critical_recall == pytest.approx(ref["CRITICAL"][1])
