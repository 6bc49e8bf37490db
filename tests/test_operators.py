"""Operators against independent numpy loops, and invariants."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.special import gamma_cdf, gamma_quantile, register
from tidemark.operators import clustering, contract, evaluate, kernels, labels, paths, segments, thresholds, windows
from tidemark.series import chunked, normalize_series, with_ordinal


def series(spark, values, series_id="s", **more):
    rows = [(series_id, k + 1, None if v is None else float(v), *(float(c[k]) for c in more.values())) for k, v in enumerate(values)]
    schema = "series_id string, i int, close double" + "".join(f", {n} double" for n in more)
    return spark.createDataFrame(rows, schema).withColumn("ts", F.date_add(F.lit("2020-01-01").cast("date"), F.col("i") - 1)).withColumn("volume", F.col("i").cast("long"))


def column(df, name):
    return [r[name] for r in df.orderBy("series_id", "i").select("series_id", "i", name).collect()]


PRICES = np.exp(np.cumsum(np.random.default_rng(4).normal(0, 0.02, 400))) * 100


def test_constant_zero_and_missing_prices(spark):
    df = windows.log_return(series(spark, [5, 5, 0, None, 5, 5]))
    assert column(df, "ret") == [None, 0.0, None, None, None, 0.0]
    assert column(windows.log_return(series(spark, [5, 5, 0]), first="guard"), "ret")[2] == pytest.approx(math.log(1e-12 / 5))
    assert windows.log_return(series(spark, [1, 2, 3]), first="drop").count() == 2
    z = windows.z_threshold(series(spark, [1.0] * 30).withColumn("score", F.lit(1.0)), "score")
    assert column(z, "threshold")[18:20] == [None, pytest.approx(1.01)]
    assert column(windows.rsi(series(spark, [3.0] * 20)), "rsi")[-1] is None


def test_expanding_z_handles_constants(spark):
    assert column(windows.expanding_z(series(spark, [2.0] * 5), "close"), "z") == [0.0] * 5


def test_signature_sums_equal_loops(spark):
    df = paths.scaled_path(windows.log_return(series(spark, PRICES[:90])))
    got = paths.iterated_sums(df, 15, level=3).orderBy("i").collect()
    x = np.array([r["x"] for r in got])
    t = np.array([r["t"] for r in got])
    for end in (14, 40, 89):
        p = {"x": x[end - 14:end + 1], "t": t[end - 14:end + 1]}
        d = {c: np.diff(v) for c, v in p.items()}
        for a in "tx":
            assert got[end][f"s_{a}"] == pytest.approx(d[a].sum())
            for b in "tx":
                assert got[end][f"s_{a}{b}"] == pytest.approx(sum(d[a][k] * d[b][m] for m in range(14) for k in range(m)), abs=1e-9)
                for c in "tx":
                    want = sum(d[a][k] * d[b][m] * d[c][n] for n in range(14) for m in range(n) for k in range(m))
                    assert got[end][f"s_{a}{b}{c}"] == pytest.approx(want, abs=1e-8)
    assert got[13]["s_x"] is None


def test_daily_features_equal_loops(spark):
    df = paths.scaled_path(windows.log_return(series(spark, PRICES[:60])))
    got = paths.daily_outer(df, 20).orderBy("i").collect()
    x = np.array([r["x"] for r in got])
    h = np.diff(np.diff(x[20:40]))
    assert got[40]["o_x"] == pytest.approx(h.mean()) and got[40]["o_xx"] == pytest.approx((np.cumsum(h) * h).sum() / 18)
    assert got[19]["o_x"] is None


def test_subpath_transform(spark):
    got = paths.subpath_transform(series(spark, PRICES[:10]), "close", 8).orderBy("i").collect()
    z = lambda v: (v - v.mean()) / (v.std() + 1e-12)
    assert got[9]["channel"] == pytest.approx(list(z(np.diff(z(PRICES[2:10])))))
    assert got[5]["channel"] is None


def test_ensembles_of_short_series(spark):
    subs = paths.subpaths(series(spark, PRICES[:50]), 20, 20)
    assert [(r["sub_id"], r["start_i"], r["end_i"]) for r in subs.orderBy("sub_id").collect()] == [(0, 1, 20), (1, 21, 40)]
    assert [tuple(r)[1:] for r in paths.ensembles(subs, 3).collect()] == [(0, 0, 1)]
    assert paths.ensembles(subs, 3, short="none").count() == 0
    assert paths.ensembles(subs, 2, sliding=False).count() == 1


def mmd(x, y, sigma=None, mode="raw"):
    def k(a, b):
        return a @ b.T if sigma is None else np.exp(-((a[:, None] - b[None]) ** 2).sum(2) / (2 * sigma**2))

    n, m = len(x), len(y)
    raw = (k(x, x).sum() - np.trace(k(x, x))) / (n * (n - 1)) + (k(y, y).sum() - np.trace(k(y, y))) / (m * (m - 1)) - 2 * k(x, y).mean()
    return {"raw": raw, "clip": max(0, raw), "sqrt": max(0, raw) ** 0.5}[mode]


@pytest.mark.parametrize("mode", ["raw", "clip", "sqrt"])
def test_lag_scores_equal_loops(spark, mode):
    df = series(spark, PRICES[:60], v1=np.log(PRICES[:60])).withColumn("v", F.array("v1", F.col("v1") * F.col("v1")))
    v = np.stack([np.log(PRICES[:60]), np.log(PRICES[:60]) ** 2], 1)
    got = {r["i"]: r["score"] for r in kernels.lag_scores(df, "v", 6, {3: 0.7, 5: 0.3}, sigma=2.0, mode=mode).collect()}
    assert min(got) == 6 and max(got) == 55
    for e in (6, 20, 55):
        now = v[e - 1:e + 5]
        want = sum(w * mmd(now, v[e - 1 - lag:e + 5 - lag], 2.0, mode) for lag, w in ((3, 0.7), (5, 0.3)))
        assert got[e] == pytest.approx(want, abs=1e-9)


def test_reference_window_and_consecutive_scores(spark):
    df = series(spark, PRICES[:80], a=np.log(PRICES[:80]))
    got = column(kernels.reference_scores(df, ["a"], 10, 5), "score")
    v = np.log(PRICES[:80])[:, None]
    assert got[13] is None and got[40] == pytest.approx(mmd(v[26:36], v[36:41]), abs=1e-9)
    w = kernels.window_scores(df, ["a"], 10, 5, length=17)
    x = v[26:41]
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    sigma = math.sqrt(np.median(d[np.triu_indices(15, 1)]) / 2)
    assert column(w, "score")[40] == pytest.approx(mmd(x[:10], x[10:], sigma, "sqrt"), abs=1e-9)
    assert column(w, "score") == pytest.approx(column(kernels.window_scores(df, ["a"], 10, 5), "score"), nan_ok=True)
    g = df.withColumn("v", F.array("a")).withColumn("g", F.floor((F.col("i") - 1) / 8).cast("int"))
    scores = {r["g"]: r["score"] for r in kernels.consecutive_scores(g, "v", "g", gamma=0.5).collect()}
    assert scores[3] == pytest.approx(mmd(v[16:24], v[24:32], 1.0, "clip"), abs=1e-9)


def test_mmd_of_a_permutation_is_the_same_and_small_samples_are_zero(spark):
    df = spark.createDataFrame([(k % 2, [float(k), float(k * k % 7)]) for k in range(30)], "label int, v array<double>")
    one = kernels.group_mmd2(df, "v", "label", sigma=3.0).first()["mmd2"]
    assert kernels.group_mmd2(df.orderBy(F.rand(1)), "v", "label", sigma=3.0, blocks=7).first()["mmd2"] == pytest.approx(one)
    x = np.array([[k, k * k % 7] for k in range(30)], float)
    assert one == pytest.approx(mmd(x[::2], x[1::2], 3.0))
    assert spark.range(1).select(kernels.mmd2(F.lit(0.0), F.lit(0.0), F.lit(1.0), 1, 1)).first()[0] == 0.0


def test_gamma_quantile_identities():
    assert gamma_quantile(np.array([1.0]), np.array([2.0]), 0.95)[0] == pytest.approx(-2 * math.log(0.05))
    assert gamma_quantile(np.array([0.5]), np.array([2.0]), 0.95)[0] == pytest.approx(3.841458820694124)
    assert gamma_quantile(np.array([50.0]), np.array([2.0]), 0.5)[0] == pytest.approx(99.33412923598846)
    assert np.isnan(gamma_quantile(np.array([-1.0]), np.array([1.0]), 0.5)[0])
    assert gamma_cdf(np.array([3.0]), np.array([2.0]))[0] == pytest.approx(1 - math.exp(-2) * 5)


def test_sql_functions(spark):
    register(spark)
    assert spark.sql("SELECT gamma_ppf(0.95D, 1.0D, 2.0D)").first()[0] == pytest.approx(-2 * math.log(0.05))
    assert spark.sql("SELECT rbf(array(0.0D), array(2.0D), 1.0D)").first()[0] == pytest.approx(math.exp(-2))
    assert spark.sql("SELECT sig_truncated(array(0.0D, 1.0D, 3.0D), array(0.0D, 0.5D, 1.0D))").first()[0] == pytest.approx([1, 1, 3, 0.25, 1.0, 0.5, 2.0])
    assert [tuple(r) for r in spark.sql("SELECT * FROM segments(array(1, 1, 2, 1))").collect()] == [(0, 1, 2, 1), (1, 3, 3, 2), (2, 4, 4, 1)]


@pytest.mark.parametrize("width", [1, 4, 5, 6])
def test_suppression_keeps_its_distance(spark, width):
    flags = [k in (0, 4, 5, 9, 10, 20) for k in range(30)]
    df = series(spark, range(1, 31)).withColumn("hit", F.col("i").isin([k + 1 for k, f in enumerate(flags) if f]))
    kept, last = [], None
    for k, f in enumerate(flags):
        if f and (last is None or k - last >= width):
            kept.append(k + 1)
            last = k
    assert [r["i"] for r in thresholds.spaced(df, "hit", width).filter("is_change").orderBy("i").collect()] == kept
    assert [r["i"] for r in thresholds.spaced_hits(df, "hit", width).orderBy("i").collect()] == kept


def test_feedback_percentile_equals_loop(spark):
    scores = np.abs(np.random.default_rng(5).normal(size=150)).tolist()
    got = thresholds.feedback_percentile(series(spark, scores).withColumn("score", F.col("close")), at_least=20).orderBy("i").collect()
    calm = []
    for r, s in zip(got, scores):
        limit = np.quantile(calm[-200:], 0.95) if len(calm) >= 20 else None
        change = limit is not None and s > limit
        assert r["is_change"] == change and (r["threshold"] is None) == (limit is None)
        if not change:
            calm.append(s)


@pytest.mark.parametrize(("policy", "limit", "labels_in", "want"), [
    ("regime", 3, [0, 0, 0, 1, 1, 2, 2, 2, 2], [0, 0, 0, 2, 2, 2, 2, 2, 2]),
    ("regime", 3, [0, 0, 0, 1, 2, 2, 2], [0, 0, 0, 0, 2, 2, 2]),
    ("regime", 2, [1, 0, 0], [0, 0, 0]),
    ("neighbor", 2, [0, 0, 1, 2, 2, 2], [0, 0, 2, 2, 2, 2]),
    ("neighbor", 2, [0, 0, 0, 1], [0, 0, 0, 0]),
    ("regime", 5, [0, 0], [0, 0]),
    ("smallest", 2, [0, 0, 1, 2, 2], [0, 0, 0, 2, 2]),
])
def test_merges(spark, policy, limit, labels_in, want):
    df = series(spark, range(1, len(labels_in) + 1)).withColumn("regime", F.get(F.array(*map(F.lit, labels_in)), F.col("i") - 1))
    assert column(segments.merged(df, policy=policy, limit=limit), "regime") == want


def test_majority_vote_ties_take_the_smallest(spark):
    df = series(spark, range(1, 5)).withColumn("l", F.get(F.array(*map(F.lit, [2, 1, 1, 2])), F.col("i") - 1))
    assert column(windows.majority_vote(df, "l", [0, 1, 2], 3), "vote") == [1, 1, 1, 1]


def test_dwells_sum_to_rows_and_flags_mark_changes(spark):
    df = clustering.tercile_regimes(windows.log_return(series(spark, PRICES)))
    runs = segments.segments(df).collect()
    assert sum(r["n_days"] for r in runs) == len(PRICES)
    flags = column(windows.change_flag(df, "regime"), "transition_flag")
    assert sum(flags) == len(runs) - 1 and flags[0] == 0


def test_causal_operators_ignore_the_future(spark):
    whole, cut = (windows.log_return(series(spark, PRICES[:n])).withColumn("score", F.abs("ret")) for n in (200, 150))
    for op, name in ((lambda d: windows.z_threshold(d, "score"), "threshold"), (lambda d: windows.quantile_threshold(d, "score"), "threshold"), (lambda d: windows.expanding_z(d, "score"), "z"), (windows.rsi, "rsi"),
                     (lambda d: windows.ema(d, "close"), "ema"), (lambda d: kernels.reference_scores(d.na.fill(0.0), ["ret"], 20, 10), "score"), (lambda d: paths.iterated_sums(d.withColumn("x", F.col("close")), 10, ("x",)), "s_xx")):
        assert column(op(whole), name)[:150] == pytest.approx(column(op(cut), name), nan_ok=True)


def test_ema_equals_loop(spark):
    want, last = [], None
    for p in PRICES:
        last = p if last is None else 0.1 * p + 0.9 * last
        want.append(last)
    assert column(windows.ema(series(spark, PRICES), "close"), "ema") == pytest.approx(want)


def test_chunks_give_the_same_frames(spark):
    df = windows.log_return(series(spark, PRICES))
    whole = column(windows.rolling_sum(df, "ret", 20, "s"), "s")
    parts = chunked(df, 50, 19).withColumn("sid", F.col("series_id")).withColumn("series_id", F.concat("series_id", F.lit("/"), F.col("chunk").cast("string")))
    parts = windows.rolling_sum(parts, "ret", 20, "s").filter("own").withColumn("series_id", F.col("sid"))
    assert column(parts, "s") == pytest.approx(whole, nan_ok=True)


def test_ordinals_by_bucket(spark):
    df = series(spark, PRICES[:100]).drop("i")
    a = {r["ts"]: r["i"] for r in with_ordinal(df).collect()}
    assert a == {r["ts"]: r["i"] for r in with_ordinal(df, bucket=F.trunc("ts", "month")).collect()}


def test_normalize_finds_columns_and_cleans(spark):
    df = spark.createDataFrame([("2020-01-02", float("nan"), 7), ("2020-01-01", 3.0, 5), (None, 1.0, 1)], "Date string, Close double, Volume int")
    got = normalize_series(df).orderBy("i").collect()
    assert [(r["i"], r["close"], r["volume"]) for r in got] == [(1, 3.0, 5), (2, None, 7)]
    with pytest.raises(ValueError, match="no date or price"):
        normalize_series(spark.range(1))


def test_ari_is_one_for_equal_and_relabeled(spark):
    df = spark.createDataFrame([(k % 3, (k % 3 + 1) % 3, k % 2) for k in range(30)], "a int, b int, c int")
    assert evaluate.adjusted_rand(df, "a", "a").first()["ari"] == pytest.approx(1.0)
    assert evaluate.adjusted_rand(df, "a", "b").first()["ari"] == pytest.approx(1.0)
    assert evaluate.adjusted_rand(df, "a", "c").first()["ari"] < 0.1


@pytest.mark.parametrize(("days", "segs", "score"), [(1168, 6, 15.0), (1168, 31, 15.0), (1168, 27, 15.0), (1168, 3, 15.0), (1168, 91, 11.2887), (100, 100, 0.0), (1000, 1, 12.0)])
def test_stability_of_known_outputs(spark, days, segs, score):
    cuts = sorted({round(k * days / segs) for k in range(segs)})
    df = series(spark, range(1, days + 1)).withColumn("regime", (F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("i"))) % 2))
    assert evaluate.stability(df).first()["score"] == pytest.approx(score, abs=1e-4)


def test_composite_example_and_short_windows(spark):
    df = spark.createDataFrame([("a", 1000, 23.0, 13.8, 15.3, 16.0, 7.5), ("b", 100, 25.0, 15.0, 25.0, 0.0, 10.0)], "series_id string, n_days int, separability double, stability double, alignment double, walk_forward double, responsiveness double")
    got = {r["series_id"]: (r["total"], r["grade"]) for r in evaluate.composite(df).collect()}
    assert got == {"a": (75.6, "B"), "b": (100.0, "A")}
    points = spark.createDataFrame([(0.42, 23.0), (0.6, 25.0), (-0.1, 0.0), (0.1, 7.5)], "s double, want double")
    assert all(r[0] == pytest.approx(r[1]) for r in points.select(evaluate.separability_score(F.col("s")), "want").collect())


def test_silhouette_equals_loop(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(20, 2)), rng.normal(size=(25, 2)) + 3])
    l = np.array([0] * 20 + [1] * 25)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, l)], "a double, b double, l int")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    own = np.array([d[i][l == l[i]].sum() / ((l == l[i]).sum() - 1) for i in range(45)])
    other = np.array([d[i][l != l[i]].mean() for i in range(45)])
    assert evaluate.silhouette(df, ["a", "b"], "l").first()["silhouette"] == pytest.approx(((other - own) / np.maximum(own, other)).mean())


def test_event_response_window(spark):
    events = spark.createDataFrame([("s", 1, "2020-01-10"), ("s", 2, "2020-03-01")], "series_id string, event int, d string").withColumn("event_ts", F.to_date("d"))
    changes = spark.createDataFrame([("s", "2020-01-08"), ("s", "2020-01-13"), ("s", "2020-02-20")], "series_id string, d string").withColumn("ts", F.to_date("d"))
    got = {r["event"]: (r["lag_days"], r["score"]) for r in evaluate.event_response(events, changes).collect()}
    assert got == {1: (-2, pytest.approx(0.8)), 2: (None, 0.0)}


def test_linkage_equals_naive(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(12, 2)), rng.normal(size=(9, 2)) + 8, rng.normal(size=(7, 2)) - 8])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for method in ("ward", "average"):
        got = clustering.linkage_labels(d, 3, method)
        assert len({(int(g), k // 1) for g, k in zip(got, [0] * 12 + [1] * 9 + [2] * 7)}) == 3
    assert clustering.clean_distances(np.array([[1.0, np.inf], [np.inf, 1.0]])).tolist() == [[0.0, 10.0], [10.0, 0.0]]
    assert clustering.cluster_count(10) == 4 and clustering.cluster_count(0) == 2


def test_labels_and_confidences(spark):
    stats = spark.createDataFrame([("s", 0, 0.1, 0.1), ("s", 1, -0.1, 0.3), ("s", 2, 0.0, 0.2)], "series_id string, regime int, mean_ret double, vol double")
    named = lambda f: {r["regime"]: r["label"] for r in f(stats).collect()}
    assert named(labels.name_by_return) == {0: "bull", 1: "bear", 2: "sideways"}
    assert named(labels.name_by_risk) == {0: "bull", 1: "bear", 2: "sideways"}
    assert named(labels.name_by_rank) == {0: "low_vol_up", 1: "high_vol_down", 2: "mid_vol_up"}
    assert named(labels.name_by_volatility)[0] == "bull" and named(labels.name_by_volatility)[1] == "bear"
    df = series(spark, [1, 2, 3, 4], d1=[0, 1, 2, 3], d2=[3, 2, 1, 0])
    for c in column(labels.blended_confidence(df, ["d1", "d2"]), "confidence"):
        assert 0 <= c <= 1


def _output(spark, n=120, **bad):
    df = clustering.tercile_regimes(windows.log_return(series(spark, PRICES[:n]))).withColumn("regime", F.floor(F.col("i") / 50).cast("int"))
    out = contract.to_output(df)
    return out.withColumns({k: F.when(F.dayofyear("date") == 60, F.lit(v)).otherwise(F.col(k)) for k, v in bad.items()})


def test_contract_accepts_and_refuses(spark):
    meta = contract.metadata("tercile_vol", "Volatility terciles", "volatility", {0: "low", 1: "mid", 2: "high"}, {}, ["vol"])
    contract.validate(_output(spark), meta)
    for bad, rule in (({"confidence": 1.5}, "confidence_range"), ({"confidence": 0.123456}, "confidence_decimals"), ({"predicted_regime": -1}, "regime_negative"), ({"predicted_regime": 7}, "regime_gaps"), ({"transition_flag": 1}, "flag_is_change"), ({"transition_flag": 3}, "flag_values")):
        with pytest.raises(ValueError, match=rule):
            contract.validate(_output(spark, **bad))
    with pytest.raises(ValueError, match="few_rows"):
        contract.validate(_output(spark, 60))
    with pytest.raises(ValueError, match="missing columns"):
        contract.validate(_output(spark).drop("confidence"))
    assert contract.metadata_problems({**meta, "algorithm": "Bad Name"}) == ["algorithm name"]
    assert contract.metadata_problems(meta, {0, 1}) and contract.metadata_problems({})


def _blobs(spark, names="ab"):
    rng = np.random.default_rng(12)
    rows = []
    for k, s in enumerate(names):
        x = np.concatenate([rng.normal(size=(30, 2)) * 0.3 + c for c in ((k, 0), (4, k), (0, 5))])
        rows += [(s, i + 1, float(a), float(b)) for i, (a, b) in enumerate(x)]
    return rows, spark.createDataFrame(rows, "series_id string, i int, x double, y double")


def test_kmeans_takes_the_restarts_and_iterations_of_the_reference(spark, monkeypatch):
    made = []
    fit = clustering.KMeans
    monkeypatch.setattr(clustering, "KMeans", lambda **options: made.append(options) or fit(**options))
    monkeypatch.setattr(clustering, "LONG", 30)  # by all tasks
    df = spark.createDataFrame([("a", i, float(i % 7), float(i % 5)) for i in range(40)], "series_id string, i int, x double, y double")
    assert clustering.kmeans(df, ["x", "y"], 3).count() == 40
    assert len({m["seed"] for m in made}) == 10 and {m["maxIter"] for m in made} == {500}


@pytest.mark.parametrize("long", [1_000_000, 50])
def test_kmeans_clusters_each_series_by_itself(spark, monkeypatch, long):
    monkeypatch.setattr(clustering, "LONG", long)
    rows, df = _blobs(spark)
    got = {(r["series_id"], r["i"]): (r["regime"], r["d_own"], r["d_other"]) for r in clustering.kmeans(df, ["x", "y"], 3).collect()}
    alone = {(r["series_id"], r["i"]): (r["regime"], r["d_own"], r["d_other"]) for r in clustering.kmeans(df.filter("series_id = 'b'"), ["x", "y"], 3).collect()}
    assert len(alone) == 90 and all(got[k][0] == v[0] and got[k][1:] == pytest.approx(v[1:]) for k, v in alone.items())
    for s in "ab":
        x = np.array([r[2:] for r in rows if r[0] == s])
        x = (x - x.mean(0)) / (x.std(0) + 1e-12)
        sides = [x[30 * k:30 * k + 30].mean(0) for k in range(3)]
        order = sorted(range(3), key=lambda k: tuple(sides[k]))
        for i, point in enumerate(x):
            gaps = sorted(np.sqrt(((point - c) ** 2).sum()) for c in sides)
            assert got[s, i + 1][0] == order.index(i // 30) and got[s, i + 1][1:] == pytest.approx(gaps[:2])


def test_kmeans_of_few_rows_and_the_cost_of_its_fits(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 1.0), ("a", 2, 1.0, 1.0), ("b", 1, 1.0, 2.0), ("c", 1, None, 2.0)], "series_id string, i int, x double, y double")
    assert {(r["series_id"], r["i"], r["regime"], r["d_own"]) for r in clustering.kmeans(df, ["x", "y"], 3).collect()} == {("a", 1, 0, 0.0), ("a", 2, 0, 0.0), ("b", 1, 0, 0.0)}
    x = np.random.default_rng(3).normal(size=(60, 2))
    for t in range(5):
        centres, cost = clustering.lloyd(x, 3, np.random.default_rng(t))
        d = ((x[:, None] - centres[None]) ** 2).sum(2)
        assert cost == pytest.approx(d.min(1).sum())
        assert all(centres[j] == pytest.approx(x[d.argmin(1) == j].mean(0)) for j in range(3))
