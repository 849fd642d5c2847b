"""Detectors against brute force on small tables."""

from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spendguard.detectors import gmm, lof, neighbors, ocsvm, sod
from spendguard.detectors.gmm import Layout, Mixture, cluster_weighted, fit_gmm, fit_mixtures, log_sum, score_gmm
from spendguard.detectors.grouped import map_with_model
from spendguard.detectors.iforest import average_path, fit_iforest, score_iforest
from spendguard.detectors.lof import lof_reference
from spendguard.detectors.neighbors import nearest, pack_blocks
from spendguard.detectors.ocsvm import GAP, RandomFeatures, fit_ocsvm, score_ocsvm, shortest_mean
from spendguard.detectors.silhouette import silhouette, squared_silhouette
from spendguard.detectors.space import Space, apply_scaler, dense_points, fit_buckets, fit_scaler, shares_by_category, squared_distances
from spendguard.operators.explain import TreeShap, tree_shap
from spendguard.params import Params
from spendguard.scratch import dealt, materialise

SPACE = Space(numeric=("a", "b", "c"), buckets=("fav_bucket", "cta_bucket"), sizes=(8, 4), names=("fav", "cta"))
PARAMS = Params(iforest_trees=50, gmm_max_components=3)


def table(n=1500, seed=1):
    """Two categories, one with two thirds of the rows and one bucket that holds most of them."""
    rng = np.random.default_rng(seed)
    df = pd.DataFrame({"record_id": rng.permutation(n).astype("int64") + 1000})
    df["category_key"] = np.where(rng.random(n) < 0.66, "BIG", "SMALL")
    centre = rng.integers(0, 3, n)
    for c in ("a", "b", "c"):
        df[c] = rng.normal(centre * 6.0, 1.0)
    df["fav_bucket"] = np.where(rng.random(n) < 0.5, 0, rng.integers(0, 8, n)).astype("int32")
    df["cta_bucket"] = rng.integers(0, 4, n).astype("int32")
    df["planted"] = False
    far = df.index[:10]
    df.loc[far, ["a", "b", "c"]] = rng.normal(60, 20, (10, 3))
    df.loc[far, "planted"] = True
    return df


@pytest.fixture(scope="module")
def data(spark):
    pdf = table()
    df = materialise(spark.createDataFrame(pdf), "planted")
    scaler, buckets = fit_scaler(df, SPACE), fit_buckets(df, SPACE)
    points = materialise(apply_scaler(df, scaler, buckets, SPACE), "planted_points")
    return pdf, df, points, buckets


def dense(pdf, key):
    """Explicit standardised one-hot matrix of a category."""
    part = pdf[pdf.category_key == key].sort_values("record_id")
    cols = [part[["a", "b", "c"]].to_numpy()]
    for b, size in (("fav_bucket", 8), ("cta_bucket", 4)):
        cols.append(np.eye(size)[part[b]])
    x = np.hstack(cols)
    std = x.std(0)
    return part.record_id.to_numpy(), (x - x.mean(0)) / np.where(std > 0, std, 1)


def brute(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, 1)[:, :k]
    return np.take_along_axis(d, order, 1), order


@pytest.mark.parametrize("block", [16, 64, 512])
def test_nearest_equals_one_hot_brute_force(data, block):
    pdf, _, points, _ = data
    blocks = pack_blocks(points, SPACE, block)
    got = nearest(blocks, blocks, 7, SPACE, exclude_self=True).toPandas().set_index("record_id")
    assert len(got) == len(pdf)
    for key in ("BIG", "SMALL"):
        ids, x = dense(pdf, key)
        d, _ = brute(x, 7)
        assert np.allclose(np.stack(got.loc[ids, "dist"]), d, atol=1e-9)


def test_nearest_with_ties_few_references_and_missing_category(spark):
    pts = pd.DataFrame({"record_id": np.arange(40), "category_key": ["X"] * 37 + ["Y"] * 2 + ["Z"], "z_a": [1.0] * 37 + [0.0, 2.0, 5.0]})
    one = Space(numeric=("a",), buckets=(), sizes=(), names=())
    df = spark.createDataFrame(pts)
    refs, qs = pack_blocks(df.where("category_key != 'Z'"), one, 8), pack_blocks(df, one, 8)
    got = {r.record_id: r for r in nearest(qs, refs, 4, one, exclude_self=True).collect()}
    assert got[20].near == [0, 1, 2, 3] and got[0].near == [1, 2, 3, 4]
    assert got[37].near == [38] and got[37].dist == [2.0]
    assert 39 not in got


def test_pruning_drops_far_blocks(spark):
    n = 20_000
    df = spark.range(n).select(
        F.col("id").alias("record_id"), F.lit("X").alias("category_key"), (F.col("id") / 10).alias("z_a")
    )
    one = Space(numeric=("a",), buckets=(), sizes=(), names=())
    seen = []
    original = neighbors._run_pairs

    def spy(pairs, *args):
        seen.append(pairs.count())
        return original(pairs, *args)

    neighbors._run_pairs = spy
    try:
        blocks = pack_blocks(df, one, 100)
        found = nearest(blocks, blocks, 3, one, exclude_self=True)
        assert found.where("abs(dist[2] - 0.2) > 1e-9 and record_id not in (0, 19999)").isEmpty()
    finally:
        neighbors._run_pairs = original
    assert seen[0] == 200 and seen[1] < 5 * 200  # of 40 000 possible block pairs


def test_lof_equals_definition(data):
    pdf, _, points, _ = data
    blocks = pack_blocks(points, SPACE)
    found = materialise(nearest(blocks, blocks, 10, SPACE, exclude_self=True), "f")
    got = lof_reference(found, [3, 10]).toPandas().set_index("record_id")
    for key in ("BIG", "SMALL"):
        ids, x = dense(pdf, key)
        for k in (3, 10):
            d, near = brute(x, k)
            lrd = 1 / (np.maximum(d, d[near, k - 1]).mean(1) + 1e-10)
            assert np.allclose(got.loc[ids, f"s_{k}"], lrd[near].mean(1) / lrd, atol=1e-8)


def top_decile(scored, pdf, key="score"):
    joined = scored.toPandas().merge(pdf[["record_id", "planted"]], on="record_id")
    rank = joined.groupby("category_key")[key].rank(pct=True)
    return joined, (rank[joined.planted] > 0.9).all()


def test_forest(data):
    pdf, _, points, _ = data
    trees = fit_iforest(points, PARAMS, SPACE)
    assert trees.count() == 100
    shape = trees.selectExpr("max(psi) psi", "max(array_max(depth)) depth", "min(size[0]) root").first()
    assert (shape.psi, shape.root) == (256, 256) and shape.depth <= 8
    scored, found = top_decile(score_iforest(points, trees, PARAMS, SPACE), pdf)
    assert found and scored.score.between(0, 1, inclusive="neither").all()
    again = fit_iforest(points.repartition(5), PARAMS, SPACE)
    assert sorted(map(str, trees.collect())) == sorted(map(str, again.collect()))


def path_value(x, tree, known, offsets, m, node=0):
    """Expected path length when only the features in `known` are given."""
    f = tree["feature"][node]
    if f < 0:
        return tree["depth"][node] + float(average_path(tree["size"][node]))
    name = f if f < m else offsets[f - m] + int(tree["cut"][node])
    first, second = tree["child"][node], tree["child"][node] + 1
    if name in known:
        holds = x[f] <= tree["cut"][node] if f < m else x[f] != tree["cut"][node]
        return path_value(x, tree, known, offsets, m, first if holds else second)
    n = tree["size"]
    return sum(n[t] / n[node] * path_value(x, tree, known, offsets, m, t) for t in (first, second))


def test_attributions_equal_shapley_values(data):
    _, _, points, _ = data
    small = PARAMS.with_(iforest_trees=3, iforest_sample=24)
    trees = [t.asDict() for t in fit_iforest(points, small, SPACE).where("category_key = 'BIG'").collect()]
    cols = [*SPACE.z, *SPACE.buckets]
    x = points.where("category_key = 'BIG'").limit(6).toPandas()[cols].to_numpy(float)
    offsets = 3 + np.cumsum([0, *SPACE.sizes[:-1]])
    for tree in trees:
        phi, base = tree_shap(x, tree, offsets, 3, SPACE.width)
        for r in range(len(x)):
            whole = path_value(x[r], tree, set(range(SPACE.width)), offsets, 3)
            assert phi[r].sum() + base == pytest.approx(whole)
        features = sorted({int(f) if f < 3 else int(offsets[f - 3] + c) for f, c in zip(tree["feature"], tree["cut"]) if f >= 0})
        if len(features) > 12:
            continue
        n = len(features)
        for j in features:
            rest = [f for f in features if f != j]
            value = sum(
                factorial(s) * factorial(n - s - 1) / factorial(n)
                * (path_value(x[0], tree, {*S, j}, offsets, 3) - path_value(x[0], tree, set(S), offsets, 3))
                for s in range(n) for S in combinations(rest, s)
            )
            assert phi[0, j] == pytest.approx(value, abs=1e-9)
    assert base == pytest.approx(path_value(x[0], trees[-1], set(), offsets, 3))


def test_attributions_looked_up_equal_computed_ones(data):
    _, _, points, _ = data
    trees = [t.asDict() for t in fit_iforest(points, PARAMS.with_(iforest_trees=2, iforest_sample=64), SPACE).where("category_key = 'BIG'").collect()]
    x = points.where("category_key = 'BIG'").limit(300).toPandas()[[*SPACE.z, *SPACE.buckets]].to_numpy(float)
    offsets = 3 + np.cumsum([0, *SPACE.sizes[:-1]])
    for tree in trees:
        looked_up, computed = (TreeShap(tree, offsets, 3, SPACE.width, n)(x) for n in (10**9, 1))
        assert len(x) > 100 and np.allclose(looked_up, computed, atol=1e-12)


def test_mixture(data, spark):
    pdf, _, points, buckets = data
    model = fit_gmm(points, buckets, PARAMS, SPACE)
    scored, found = top_decile(score_gmm(points, model, PARAMS, SPACE), pdf)
    assert found and np.isfinite(scored.score).all()
    sizes = fit_mixtures(points, buckets, PARAMS, SPACE).toPandas()
    assert sorted(zip(sizes.category_key, sizes.n_components)) == [(c, k) for c in ("BIG", "SMALL") for k in (1, 2, 3)]
    for key, part in sizes.groupby("category_key"):
        _, x = dense(pdf, key)
        d = x.shape[1]
        free = {k: k - 1 + k * d + k * d * (d + 1) // 2 for k in (1, 2, 3)}
        for row in part.to_dict("records"):
            k = row["n_components"]
            mean = log_sum(dense_log_parts(Mixture.from_row(row), x)).mean()
            assert row["n_rows"] == len(x) and row["log_likelihood"] == pytest.approx(mean, abs=1e-7)
            assert row["bic"] == pytest.approx(-2 * mean * len(x) + free[k] * np.log(len(x)), rel=1e-9)
        best = part.sort_values(["bic", "n_components"]).n_components.iloc[0]
        assert model.where(F.col("category_key") == key).first()["n_components"] == best > 1


def dense_log_parts(mixture, x):
    """Log of weight × density from whole matrices."""
    out = []
    for w, mean, cov in zip(mixture.weights, mixture.means, mixture.covariances):
        y = np.linalg.solve(np.linalg.cholesky(cov), (x - mean).T)
        out.append(np.log(w) - 0.5 * (len(mean) * np.log(2 * np.pi) + (y * y).sum(0) + np.linalg.slogdet(cov)[1]))
    return np.stack(out, axis=1)


def test_look_ups_equal_dense_matrices(data, spark):
    """Densities and moments by bucket against the explicit one-hot columns."""
    pdf, _, points, buckets = data
    shares = shares_by_category(buckets, SPACE).toPandas().set_index("category_key")
    for key in ("BIG", "SMALL"):
        ids, x = dense(pdf, key)
        rows = points.where(F.col("category_key") == key).toPandas().set_index("record_id").loc[ids]
        place = Layout(SPACE, [np.asarray(shares.loc[key, f"share_{b}"], float) for b in SPACE.buckets])
        z, codes = place.read(rows[SPACE.point].to_numpy(float))
        r = np.random.default_rng(4).random((len(x), 2))
        moments = [place.unfold(place.moments(z, codes, r[:, j])) for j in range(2)]
        for j, (n, first, second) in enumerate(moments):
            assert n == pytest.approx(r[:, j].sum()) and np.allclose(first, r[:, j] @ x, atol=1e-7)
            assert np.allclose(second, (x * r[:, j : j + 1]).T @ x, atol=1e-6)
        count, first, second = (np.array(v) for v in zip(*moments))
        mixture = Mixture.from_moments(count, first, second, count.sum(), 1e-4)
        want = dense_log_parts(mixture, x)
        assert np.allclose(mixture.prepared(place).log_parts(z, codes), want, atol=1e-6)
        centres = Mixture(np.ones(2), x[:2], None).prepared(place)
        nearest_centre = ((x[:, None] - x[None, :2]) ** 2).sum(-1).argmin(1)
        assert (centres.shares(z, codes)[1].argmax(1) == nearest_centre).mean() > 0.99


@pytest.mark.parametrize("limit", [None, 0])
def test_em_equals_dense_em(data, spark, monkeypatch, limit):
    """The same steps on whole matrices, with the models sent around or met by chunks."""
    if limit is not None:
        monkeypatch.setattr(gmm, "map_with_model", lambda *a, **k: map_with_model(*a, **k, bytes_limit=limit, chunk_rows=300))
    pdf, _, points, buckets = data
    shares = materialise(shares_by_category(buckets, SPACE), "shares")
    params = PARAMS.with_(gmm_max_components=2)
    model = materialise(gmm._starts(points, shares, params, SPACE), "starts")
    centres = {(r["category_key"], r["n_components"]): np.array(r["means"]).reshape(r["n_components"], -1) for r in model.collect()}
    for _ in range(4):
        model = materialise(gmm.em_step(points, model, shares, params, SPACE), "step")
    for row in model.collect():
        _, x = dense(pdf, row["category_key"])
        r = np.eye(row["n_components"])[((x[:, None] - centres[row["category_key"], row["n_components"]]) ** 2).sum(-1).argmin(1)]
        for _ in range(4):
            second = np.stack([(x * r[:, j : j + 1]).T @ x for j in range(r.shape[1])])
            want = Mixture.from_moments(r.sum(0), r.T @ x, second, len(x), params.gmm_reg_covar)
            logs = dense_log_parts(want, x)
            r = np.exp(logs - log_sum(logs)[:, None])
        got = Mixture.from_row(row)
        assert np.allclose(got.weights, want.weights, atol=1e-6) and np.allclose(got.means, want.means, atol=1e-5)
        assert np.allclose(got.covariances, want.covariances, atol=1e-4)


def test_weighted_candidates_are_clustered():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (30, 2)), rng.normal(8, 1, (10, 2))])
    centres = cluster_weighted(x, np.ones(40), 2, 7)
    assert np.allclose(np.sort(centres[:, 0]), [x[:30, 0].mean(), x[30:, 0].mean()])
    assert cluster_weighted(x[:1], np.ones(1), 3, 7).shape == (3, 2)


@pytest.mark.parametrize("piece", [2000, 5])
def test_subspace_degree_equals_brute_force(spark, piece, monkeypatch):
    """All training rows are references; a third of the rows are copies of one."""
    monkeypatch.setattr(sod.reference_sets, "__defaults__", (sod.REFERENCE_SET, piece))
    pdf = table(500, 3)
    same = pdf.index[pdf.category_key == "BIG"][20:130]
    for c in ("a", "b", "c", "fav_bucket", "cta_bucket"):
        pdf.loc[same, c] = pdf.loc[same[0], c]
    df = materialise(spark.createDataFrame(pdf), "sod_rows")
    scaler, buckets = fit_scaler(df, SPACE), fit_buckets(df, SPACE)
    points = materialise(apply_scaler(df, scaler, buckets, SPACE), "sod_points")
    blocks = pack_blocks(points, SPACE)
    found = materialise(nearest(blocks, blocks, sod.NEIGHBORS, SPACE, exclude_self=True), "sod_found")
    got = sod.score_sod(points, found, sod.sod_reference(points, found, buckets, SPACE), SPACE).toPandas().set_index("record_id").score
    assert len(got) == len(pdf)
    lists = {r["record_id"]: set(r["near"]) for r in found.collect()}
    for key in ("BIG", "SMALL"):
        ids, x = dense(pdf, key)
        for i, own in enumerate(ids):
            shared = [(-len(lists[own] & lists[r]), r, j) for j, r in enumerate(ids) if r != own]
            best = [j for n, _, j in sorted(shared)[: sod.REFERENCE_SET] if n]
            want = 0.0
            if best:
                group = x[best]
                spread = np.where(group.var(0) < 1e-12, 0, group.var(0))
                kept = spread < sod.ALPHA * spread.mean()
                want = np.sqrt(((x[i, kept] - group[:, kept].mean(0)) ** 2).sum()) / max(kept.sum(), 1)
            assert got[own] == pytest.approx(want, abs=1e-7)


def test_passes_read_rows_where_they_lie(data, spark, monkeypatch):
    """Rows are dealt out once for all passes: in many files, each sorted, and no pass of a fit moves them again."""
    _, _, points, buckets = data
    table = dealt(points, "category_key", name="dealt_points")
    assert len(table.inputFiles()) >= spark.sparkContext.defaultParallelism and table.count() == points.count()
    for path in table.inputFiles():
        keys = [r.category_key for r in spark.read.parquet(path).select("category_key").collect()]
        assert keys == sorted(keys)
    moved = []
    monkeypatch.setattr(gmm, "map_with_model", lambda *a, **k: moved.append(not k.get("laid_out")) or map_with_model(*a, **k))
    fit_mixtures(points, buckets, PARAMS.with_(gmm_max_components=2, gmm_max_iter=2), SPACE)
    assert len(moved) > 6 and not any(moved)


def exact_weights(kernel, nu, steps=20000):
    """Minimise ½ αᵀKα with 0 ≤ α ≤ 1 and Σα = νn by moving weight between the most violating pair."""
    n = len(kernel)
    alpha = np.zeros(n)
    alpha[: int(nu * n)] = 1.0
    grad = kernel @ alpha
    for _ in range(steps):
        i, j = np.where(alpha < 1, grad, np.inf).argmin(), np.where(alpha > 0, grad, -np.inf).argmax()
        if grad[j] - grad[i] < 1e-3:
            break
        move = min((grad[j] - grad[i]) / max(2 - 2 * kernel[i, j], 1e-12), 1 - alpha[i], alpha[j])
        alpha[i] += move
        alpha[j] -= move
        grad += move * (kernel[i] - kernel[j])
    return grad


def test_one_class_svm(data):
    pdf, _, points, _ = data
    model = fit_ocsvm(points, PARAMS, SPACE)
    scored, found = top_decile(score_ocsvm(points, model, PARAMS, SPACE), pdf)
    assert found
    assert ((scored.score > 0).groupby(scored.category_key).mean() < 0.12).all()
    # The exact kernel solution ranks the rows alike.
    ids, x = dense(pdf, "BIG")
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / SPACE.width)
    want = pd.Series(-exact_weights(kernel, PARAMS.ocsvm_nu)).rank()
    mine = scored.set_index("record_id").score[ids].reset_index(drop=True).rank()
    assert np.corrcoef(want, mine)[0, 1] > 0.8
    # The stored gap bounds the true one, and the offset cuts off the wanted share.
    for row in model.collect():
        w, part = np.array(row.weights), points.where(F.col("category_key") == row.category_key).toPandas()
        score = np.sort(RandomFeatures(SPACE, PARAMS.random_seed)(part[SPACE.point].to_numpy(float)) @ w)
        wanted = PARAMS.ocsvm_nu * len(score)
        lowest = (score[: int(wanted)].sum() + (wanted % 1) * score[int(wanted)]) / wanted
        assert w @ w - lowest <= row.gap + 1e-5
        assert row.gap <= GAP * (w @ w) and row.passes < 40
        assert abs((score < row.rho).mean() - PARAMS.ocsvm_nu) < 0.01


def test_one_class_svm_handles_odd_categories(spark):
    rows = [("SAME", i, 0.5, 0.5, 0.5, 0, 0) for i in range(300)] + [("ONE", 300, 1.0, 0.0, 0.0, 1, 1)]
    names = ["category_key", "record_id", *SPACE.z, *SPACE.buckets]
    odd = spark.createDataFrame(rows, names).withColumns({w: F.lit(1.0) for w in SPACE.weights}).select(*names[:2], *SPACE.point)
    model = fit_ocsvm(odd, PARAMS, SPACE)
    assert {r.category_key: r.passes for r in model.collect()} == {"SAME": 2, "ONE": 2}
    scores = score_ocsvm(odd, model, PARAMS, SPACE).toPandas()
    assert len(scores) == 301 and np.allclose(scores.score, 0, atol=1e-5)
    assert fit_ocsvm(odd.limit(0), PARAMS, SPACE).count() == 0


def test_shortest_mean_of_vectors():
    rng = np.random.default_rng(5)
    for n in (1, 2, 5, 12):
        x = rng.normal(0.5, 1, (n, 8))
        share = shortest_mean(x @ x.T)
        mean = share @ x
        assert share.min() >= 0 and share.sum() == pytest.approx(1)
        assert mean @ mean <= (x @ mean).min() + 1e-6  # no vector is on the near side


def test_merged_results_leave_a_task_that_holds_many_categories(spark):
    rows = spark.range(600).selectExpr("concat('C', id % 150) as category_key", "id as record_id").coalesce(1)
    model = rows.select("category_key").distinct()
    one = lambda part, known: pd.DataFrame({"category_key": part.category_key.iloc[:1], "n": [len(part)]})
    add = lambda a, b: a.assign(n=a.n + b.n.to_numpy())
    got = map_with_model(rows, model, one, "category_key string, n long", 1, combine=add, laid_out=True, held_categories=10)
    assert {r.n for r in got.groupBy("category_key").agg(F.sum("n").alias("n")).collect()} == {4}


def test_squared_silhouette(data):
    pdf, _, points, _ = data
    labels = F.array((F.col("z_a") > 0.3).cast("int"), (F.col("z_b") > 0.5).cast("int"), F.lit(1))
    labelled = materialise(points.withColumn("labels", labels))
    got = {(r.category_key, r.labelling): r.silhouette for r in squared_silhouette(labelled, SPACE).collect()}
    assert {k for _, k in got} == {0, 1}
    for key in ("BIG", "SMALL"):
        _, x = dense(pdf, key)
        rows = labelled.where(F.col("category_key") == key).orderBy("record_id").toPandas()
        d = ((x[:, None] - x[None]) ** 2).sum(-1)
        for k in (0, 1):
            mine = np.array([v[k] for v in rows.labels])
            one = np.stack([d[:, mine == g].mean(1) for g in (0, 1)], axis=1)
            n = np.array([(mine == g).sum() for g in (0, 1)])
            inside = one[np.arange(len(x)), mine] * n[mine] / (n[mine] - 1)
            outside = one[np.arange(len(x)), 1 - mine]
            assert got[key, k] == pytest.approx(((outside - inside) / np.maximum(inside, outside)).mean(), abs=1e-9)


def test_model_in_chunks_equals_model_everywhere(data):
    _, _, points, _ = data
    trees = fit_iforest(points, PARAMS, SPACE)
    schema = "category_key string, record_id bigint, n int"
    fn = lambda rows, model: pd.DataFrame(
        {"category_key": rows.category_key, "record_id": rows.record_id, "n": len(model)}
    )
    small = map_with_model(points, trees, fn, schema, 1)
    large = map_with_model(points, trees, fn, schema, 1, bytes_limit=0, chunk_rows=100)
    assert sorted(small.collect()) == sorted(large.collect())


def test_dense_points_equal_standardised_columns(data):
    pdf, _, points, buckets = data
    row = shares_by_category(buckets, SPACE).where("category_key = 'BIG'").first()
    part = points.where("category_key = 'BIG'").orderBy("record_id").toPandas()
    x = dense_points(part[SPACE.point].to_numpy(float), [np.array(row.share_fav_bucket), np.array(row.share_cta_bucket)], SPACE)
    _, want = dense(pdf, "BIG")
    assert np.allclose(x, want)


def test_shared_neighbours_meet_as_arrays(spark):
    """Pairs of a record and the classes next to it are counted in a task and never shuffled as rows."""
    lists = [("A", i, [i % 4, (i * 3) % 5 + 10, (i * 7) % 6 + 20]) for i in range(60)]
    df = materialise(spark.createDataFrame(lists, "category_key string, record_id long, near array<long>"), "shared_lists")
    seen = {}
    for piece in (2_000, 20, 1):  # no neighbour, some or every neighbour is a hub
        got = {r.record_id: r.members for r in sod.reference_sets(df, df, 5, piece).collect()}
        for _, i, near in lists:
            shared = sorted((-len(set(near) & set(o)), j) for _, j, o in lists if j != i and set(near) & set(o))
            assert got[i] == [j for _, j in shared[:5]]
        seen[piece] = got
    counted = next(sod._most_shared(2)(iter([pd.DataFrame({"category_key": ["A"], "asker": [1], "classes": [np.array([5, 3, 3, 4, 4])]})])))
    assert counted[["class", "_shared"]].to_numpy().tolist() == [[3, 2], [4, 2]] and seen[1] == seen[2_000]


def test_neighbour_lists_in_parts_and_of_repeated_records(spark, monkeypatch):
    """Blocks in several parts and records with several rows get one merged list, the others their list as it is."""
    monkeypatch.setattr(neighbors, "_PAIRS_PER_PART", 2)
    rng = np.random.default_rng(5)
    space = Space(numeric=("a", "b"), buckets=(), sizes=(), names=())
    ids = np.r_[np.arange(300), np.arange(5)]  # five records have a second row
    z = rng.standard_normal((305, 2))
    rows = [("A", int(i), float(x), float(y)) for i, (x, y) in zip(ids, z)]
    df = spark.createDataFrame(rows, "category_key string, record_id bigint, z_a double, z_b double")
    blocks = pack_blocks(df, space, block_points=8)
    got = {r.record_id: (r.dist, r.near) for r in nearest(blocks, blocks, 4, space, exclude_self=True).collect()}
    assert len(got) == 300
    d = ((z[:, None] - z[None]) ** 2).sum(2)
    for i in range(300):
        pairs = sorted((d[q, r], int(ids[r])) for q in np.flatnonzero(ids == i) for r in range(305) if ids[r] != i)[:4]
        assert got[i][1] == [r for _, r in pairs]
        assert got[i][0] == pytest.approx([x**0.5 for x, _ in pairs], abs=1e-9)


def test_far_search_goes_on_from_known_lists(monkeypatch):
    """References beyond the lists so far are not measured, and a team's blocks are held once."""
    blob = lambda *x: np.array(x).tobytes()
    columns = ["category_key", "team", "part", "is_ref", "block", "ids", "pts", "targets", "dist", "near"]
    ids = np.array([1, 2]).tobytes()
    query = ("A", 1, 0, False, 1, ids, blob(0.0, 1.0), [], blob(0.25, 0.25), np.array([7, 8]).tobytes())
    far = ("A", 1, 0, True, 9, np.array([9, 10]).tobytes(), blob(5.0, 6.0), [1], None, None)
    monkeypatch.setattr(neighbors, "rough_distances", None)  # would fail
    out = list(neighbors._nearest_in_teams(1, 1, 0, False)(iter([pd.DataFrame([query, far], columns=columns)])))
    assert len(out) == 1 and out[0]["near"][0] == np.array([7, 8]).tobytes() and out[0]["dist"][0] == blob(0.25, 0.25)


def test_svm_vector_that_stays_gets_fine_bins():
    """Wide bins around a lone vertex that stays the best would find the same vertex in every later pass."""
    w = np.zeros(ocsvm.FEATURES)
    w[0] = 0.6
    state = {
        "category_key": "A", "weights": w.tobytes(), "vertices": w.tobytes(), "low": -0.85, "high": 0.85, "rho": 0.0,
        "gap": 0.0, "passes": 4, "ready": False, "whole": False,
    }
    longer = w * 1.001
    bins = pd.DataFrame(
        {"category_key": "A", "bin": [40, 63], "n": [1000, 5000], "least": [0.33, 0.4], "most": [0.38, 0.5],
         "total": [(1000 * longer).tobytes(), bytes(w.nbytes)]}
    )
    after = ocsvm._improved(pd.DataFrame([state]), bins, 0.1, 40).iloc[0]
    assert not after["ready"] and after["weights"] == w.tobytes()
    assert 0.25 < after["low"] < after["rho"] < after["high"] < 0.47


def test_svm_reads_rows_of_unready_categories_and_sums_low_bins(spark, monkeypatch):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"record_id": range(400), "category_key": np.repeat(["A", "B"], 200), "z_a": rng.normal(size=400)})
    space = Space(numeric=("a",), buckets=(), sizes=(), names=())
    points = materialise(spark.createDataFrame(pdf), "svm_rows")
    features = RandomFeatures(space, 1)
    w = np.ones(ocsvm.FEATURES)
    state = lambda whole: spark.createDataFrame(
        [("A", bytearray(w.tobytes()), -1.0, 0.0, False, whole), ("B", bytearray(w.tobytes()), -1.0, 0.0, True, whole)],
        "category_key string, weights binary, low double, high double, ready boolean, whole boolean",
    )
    given = []
    kept = ocsvm.map_with_model
    monkeypatch.setattr(ocsvm, "map_with_model", lambda rows, *args, **more: (given.append(rows), kept(rows, *args, **more))[1])
    low, every = (ocsvm._added(ocsvm._bin_sums(points, state(x), features).toPandas()) for x in (False, True))
    assert given[0].select("category_key").distinct().collect() == [("A",)]
    assert low["n"].tolist() == every["n"].tolist() and low["n"].sum() == 200
    for a, b, at in zip(low["total"], every["total"], low["bin"]):
        b = np.frombuffer(b)
        assert np.allclose(np.frombuffer(a), 0 if at == ocsvm._BINS - 1 else b) and np.abs(b).sum() > 0


@pytest.mark.parametrize("block_rows", [7, 10_000])
def test_silhouette_of_all_pairs_in_blocks(spark, block_rows):
    rng = np.random.default_rng(5)
    n = 90
    pdf = pd.DataFrame({"record_id": range(n), "category_key": np.repeat(["A", "B", "C"], n // 3)})
    for c in SPACE.z:
        pdf[c] = rng.normal(size=n) + 40
    for b in SPACE.buckets:
        pdf[b], pdf[f"w_{b}"] = rng.integers(0, 3, n).astype("int32"), 4.0
    pdf = pd.concat([pdf, pdf.iloc[:6]], ignore_index=True)  # copies, at distance 0
    label = (rng.random(len(pdf)) < 0.3).astype(int)
    label[pdf["category_key"] == "C"] = 0  # one label only
    pdf["labels"] = [[int(v), int(i % 2)] for i, v in enumerate(label)]
    got = {(r.category_key, r.labelling): r.silhouette for r in silhouette(spark.createDataFrame(pdf), SPACE, block_rows).collect()}
    want = {}
    for category, part in pdf.groupby("category_key"):
        x = part[SPACE.point].to_numpy(float)
        d = np.sqrt(squared_distances(x, x, len(SPACE.numeric), len(SPACE.buckets)))
        for k, own in enumerate(np.stack(part["labels"].to_numpy()).T):
            if own.min() == own.max():
                continue
            same = own[:, None] == own
            inside, outside = (d * same).sum(1) / (same.sum(1) - 1), (d * ~same).sum(1) / (~same).sum(1)
            want[category, k] = np.mean((outside - inside) / np.maximum(inside, outside))
    assert got.keys() == want.keys() and len(got) == 5
    assert all(abs(got[k] - want[k]) < 1e-10 for k in want)


@pytest.mark.parametrize("with_blocks", [False, True])
def test_reference_sets_send_a_neighbour_once_to_a_block(spark, with_blocks, monkeypatch):
    """Classes travel to blocks, not to records; the blocks do not change the sets, with copies and repeated ids too."""
    rng = np.random.default_rng(8)
    near = {i: sorted(rng.choice(np.r_[0:i, i + 1 : 40], 6, replace=False).tolist()) for i in range(40)}
    near |= {40: near[3], 41: near[3]}
    pdf = pd.DataFrame([{"category_key": "A", "record_id": i, "near": n, "block": i // 14} for i, n in near.items()])
    pdf = pd.concat([pdf, pdf[pdf["record_id"] == 7]])
    df = materialise(spark.createDataFrame(pdf, "category_key string, record_id bigint, near array<bigint>, block bigint"), "sod_lists")
    sent = []

    def watched(table, name="table"):
        done = materialise(table, name)
        sent.append((name, done))
        return done

    monkeypatch.setattr(sod, "materialise", watched)
    got = {r.record_id: r.members for r in sod.reference_sets(df if with_blocks else df.drop("block"), df if with_blocks else df.drop("block"), 5).collect()}
    for i, mine in near.items():
        shared = sorted((-len(set(mine) & set(n)), j) for j, n in [*near.items(), (7, near[7])])
        expected = [j for n, j in shared if n < 0][:6]
        assert got[i] == [j for j in expected if j != i][:5]
    if with_blocks:
        listing = dict(sent)["sod_listing"].toPandas()
        assert len(listing) == len({(n, min(i, *[j for j in near if near[j] == near[i]]) // 14) for i in near for n in near[i]})


def test_far_search_skips_boxes_beyond_the_lists(monkeypatch):
    """A box that lies beyond what the lists have become since the pair was chosen is not looked at, nearer ones are."""
    blob = lambda *x: np.array(x).tobytes()
    columns = ["category_key", "team", "part", "is_ref", "block", "ids", "pts", "targets", "gaps", "dist", "near"]
    query = ("A", 1, 0, False, 1, np.array([1, 2]).tobytes(), blob(0.0, 1.0), [], [], blob(9.0, 9.0), np.array([7, 8]).tobytes())
    close = ("A", 1, 0, True, 3, np.array([3, 4]).tobytes(), blob(1.5, 2.5), [1], [0.25], None, None)
    far = ("A", 1, 0, True, 9, np.array([9, 10]).tobytes(), blob(4.0, 5.0), [1], [9.0], None, None)
    looked = []
    kept = neighbors._take_nearer
    monkeypatch.setattr(neighbors, "_take_nearer", lambda *a: looked.append(a[6].tolist()) or kept(*a))
    out = list(neighbors._nearest_in_teams(1, 1, 0, False)(iter([pd.DataFrame([query, close, far], columns=columns)])))
    assert looked == [[3, 4]]
    assert np.frombuffer(out[0]["near"][0], np.int64).tolist() == [3, 3] and np.frombuffer(out[0]["dist"][0]).tolist() == [2.25, 0.25]


def test_parts_of_a_block_are_merged_as_arrays():
    dist, near = np.array([[1.0, 4.0, 1.0, np.inf], [2.0, np.inf, 3.0, 5.0]]), np.array([[9, 3, 2, -1], [5, -1, 6, 7]])
    got = neighbors._merged_parts(dist, near, 3)
    assert got[0].tolist() == [[1.0, 1.0, 4.0], [2.0, 3.0, 5.0]] and got[1].tolist() == [[2, 9, 3], [5, 6, 7]]


@pytest.mark.parametrize("with_blocks", [False, True])
def test_lof_sends_a_neighbour_once_to_a_block(spark, with_blocks):
    """Neighbours travel to blocks, not to records; unknown ones do not count and a repeated one counts twice."""
    near = {1: [2, 3], 2: [3, 1], 3: [2, 9], 4: [9]}
    lists = [("A", i, 0, [float(i + j) for j in range(len(n))], n) for i, n in near.items()]
    found = spark.createDataFrame(lists, "category_key string, record_id bigint, block bigint, dist array<double>, near array<bigint>")
    refs = [("A", i, 2, i / 2, float(i)) for i in (1, 2, 3, 3)]
    reference = spark.createDataFrame(refs, "category_key string, record_id bigint, best_k int, k_distance double, density double")
    fed = found if with_blocks else found.drop("block")
    got = {r.record_id: r.score for r in lof.lof_score(fed, reference).collect()}
    edges = {i: [(r, d) for n, d in zip(near[i], l[3]) for r in refs if r[1] == n] for i, l in zip(near, lists)}
    want = {i: np.mean([r[4] for r, _ in e]) * (np.mean([max(d, r[3]) for r, d in e]) + 1e-10) for i, e in edges.items() if e}
    assert got == pytest.approx(want) and 4 not in got
    pairs = lof._meet(
        fed.coalesce(1), reference, lambda left, edges: {"n": np.full(left.num_rows, edges.known.num_rows)}, "category_key string, record_id bigint, n bigint"
    )
    assert {r.n for r in pairs.collect()} == {4}  # 1, 2, 3 and 3 for the block, of 6 known neighbours


def test_references_are_listed_once_for_all_scorings(spark, data, monkeypatch):
    """Classes, counts and shares of a reference table are written at its first scoring only."""
    _, _, points, buckets = data
    blocks = pack_blocks(points, SPACE)
    found = materialise(nearest(blocks, blocks, sod.NEIGHBORS, SPACE, exclude_self=True), "sod_found")
    reference = sod.sod_reference(points, found, buckets, SPACE)
    written = []
    monkeypatch.setattr(sod, "keep", lambda df, name: written.append(name) or materialise(df, name))
    first, second = (sod.score_sod(points, found, reference, SPACE).orderBy("category_key", "record_id").collect() for _ in range(2))
    assert first == second and {"sod_listing", "sod_shares"} <= set(written) and len(written) == len(set(written))


def test_model_is_read_in_one_job(spark, data):
    _, _, points, _ = data
    model = spark.range(2).selectExpr("if(id = 0, 'BIG', 'SMALL') category_key", "id * 5 + 1 bonus")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("read_model", "read_model")
    map_with_model(points, model, lambda rows, known: rows, points.schema.simpleString()[7:-1].replace(":", " "), 8, laid_out=True)
    assert len(tracker.getJobIdsForGroup("read_model")) == 1
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
