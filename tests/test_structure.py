import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mesoflow.operators import boundary_stats as B
from mesoflow.operators import boundary_tracks as T
from mesoflow.operators import folds as L
from mesoflow.operators import structure as S
from mesoflow.operators.geometry import close_pairs, components, delaunay, greedy_by_weight, near_candidates

RNG = np.random.default_rng(11)


def hexagons(nx, ny, a=10.0, noise=0.2, turn=0.0):
    i, j = np.meshgrid(np.arange(nx), np.arange(ny))
    x, y = (i + 0.5 * (j % 2)).ravel() * a, j.ravel() * a * math.sqrt(3) / 2
    x, y = x + RNG.normal(0, noise, x.size), y + RNG.normal(0, noise, y.size)
    c, s = math.cos(turn), math.sin(turn)
    return c * x - s * y, s * x + c * y


def table(spark, x, y, frame=0, run="r", first=0):
    return spark.createDataFrame([(run, frame, first + i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "run_id string, frame int, id bigint, x double, y double")


def brute_edges(x, y):
    out = set()
    for i, j, k in itertools.combinations(range(len(x)), 3):
        d = (x[j] - x[i]) * (y[k] - y[i]) - (y[j] - y[i]) * (x[k] - x[i])
        ax, ay, bx, by, cx, cy = x[i] - x, y[i] - y, x[j] - x, y[j] - y, x[k] - x, y[k] - y
        v = ((ax**2 + ay**2) * (bx * cy - by * cx) - (bx**2 + by**2) * (ax * cy - ay * cx) + (cx**2 + cy**2) * (ax * by - ay * bx)) * np.sign(d)
        v[[i, j, k]] = 0
        if d != 0 and not (v > 1e-9).any():
            out |= {(i, j), (j, k), (i, k)}
    return out


def test_delaunay_equals_brute_force_and_euler():
    for n in (4, 5, 9, 20, 27):
        x, y = RNG.uniform(0, 50, n), RNG.uniform(0, 50, n)
        assert {tuple(e) for e in delaunay(x, y)} == brute_edges(x, y)
    x, y = hexagons(12, 12)
    e = delaunay(x, y)
    # every inner point of a crystal has six neighbours
    coord = np.bincount(e.ravel(), minlength=144).reshape(12, 12)
    assert (coord[2:-2, 2:-2] == 6).mean() > 0.95


def test_delaunay_of_degenerate_points():
    line = np.arange(6.0)
    assert len(delaunay(line, 2 * line)) == 0 and len(delaunay(line[:2], line[:2])) == 0
    x, y = np.array([0, 10, 5, 5, 5.0]), np.array([0, 0, 8, 3, 3.0])
    assert 4 not in delaunay(x, y) or 3 not in delaunay(x, y)


def test_points_have_coordination_and_order(spark):
    x, y = hexagons(10, 10)
    p = table(spark, x, y).unionByName(table(spark, [0, 1, 2], [0, 5, 1], frame=1, first=500))
    e = S.delaunay_edges(p, "id").cache()
    s = S.structure_points(p, e, "id")
    rows = {r["id"]: r for r in s.collect()}
    inner = [rows[j * 10 + i] for j in range(2, 8) for i in range(2, 8)]
    assert np.mean([r["coord"] == 6 for r in inner]) > 0.95
    assert np.mean([math.hypot(r["psi_re"], r["psi_im"]) for r in inner]) > 0.9
    assert all(rows[k]["coord"] == 0 and rows[k]["psi_re"] == 0 for k in (500, 501, 502))
    # sum over points against a direct mean
    edges = [(r["i"], r["j"]) for r in e.where("frame = 0").collect()]
    k = 55
    near = [b if a == k else a for a, b in edges if k in (a, b)]
    psi = np.mean([np.exp(6j * math.atan2(y[n] - y[k], x[n] - x[k])) for n in near])
    assert complex(rows[k]["psi_re"], rows[k]["psi_im"]) == pytest.approx(psi)
    series = {r["frame"]: r for r in S.defect_series(s).collect()}
    assert series[1]["frac_defect"] == 1.0


def bicrystal(theta):
    """Two crystals turned by +-theta/2, joined along x = 0."""
    ax, ay = hexagons(40, 75, noise=0.05, turn=math.radians(theta / 2))
    bx, by = hexagons(40, 75, noise=0.05, turn=math.radians(-theta / 2))
    ax, ay, bx, by = ax - ax.mean(), ay - ay.mean(), bx - bx.mean(), by - by.mean()
    left, right = (ax < -3) & (ax > -150) & (np.abs(ay) < 280), (bx > 3) & (bx < 150) & (np.abs(by) < 280)
    return np.r_[ax[left], bx[right]] + 200, np.r_[ay[left], by[right]] + 350


def test_bicrystal_shows_its_angle(spark):
    x, y = bicrystal(5.0)
    p = table(spark, x, y)
    e = S.delaunay_edges(p, "id").cache()
    s = S.structure_points(p, e, "id").cache()
    inner = s.where("x > 75 and x < 325 and y > 110 and y < 590")
    pairs = S.pairs57(inner, e, "id", 30.0).cache()
    b, m = S.boundaries(pairs, 130.0, 2, 2.0, 15.0)
    main = b.orderBy(F.col("n").desc()).limit(1).withColumn("b", F.lit(10.0))
    got = S.band_misorientation(main, m, s, F.col("b")).collect()
    assert len(got) == 1 and got[0]["theta_grains_deg"] == pytest.approx(5.0, abs=0.5)


def brute_dbscan(x, y, eps, least):
    n = len(x)
    d = np.hypot(x[:, None] - x, y[:, None] - y) <= eps
    core = d.sum(1) >= least
    label = np.full(n, -1)
    for i in range(n):
        if core[i] and label[i] < 0:
            todo, label[i] = [i], i
            while todo:
                k = todo.pop()
                for q in np.flatnonzero(d[k] & core & (label < 0)):
                    label[q] = i
                    todo.append(int(q))
    for i in np.flatnonzero(~core):
        near = [label[q] for q in np.flatnonzero(d[i] & core)]
        label[i] = min(near) if near else -1
    return label


def test_dbscan_equals_brute_force(spark):
    x, y = RNG.uniform(0, 60, 150), RNG.uniform(0, 60, 150)
    got = {r["id"]: r["cluster"] for r in S.dbscan(table(spark, x, y), "id", 4.5, 4).collect()}
    assert [got[i] for i in range(150)] == brute_dbscan(x, y, 4.5, 4).tolist()


def test_components_and_pairs_and_suppression():
    i, j = np.array([0, 2, 5]), np.array([1, 3, 4])
    assert components(7, i, j).tolist() == [0, 0, 2, 2, 4, 4, 6]
    x, y = RNG.uniform(0, 30, 90), RNG.uniform(0, 30, 90)
    a, b = close_pairs(x, y, 3.0)
    want = {(p, q) for p in range(90) for q in range(p + 1, 90) if (x[p] - x[q]) ** 2 + (y[p] - y[q]) ** 2 <= 9}
    assert set(zip(a.tolist(), b.tolist())) == want
    w = RNG.uniform(size=90)
    alive = greedy_by_weight(a, b, w)
    assert not any(alive[p] and alive[q] for p, q in want)
    # a removed point has a heavier survivor near it
    assert all(alive[k] or any(alive[q] and w[q] >= w[k] for p in want if k in p for q in p if q != k) for k in range(90))
    again = greedy_by_weight(*(c[alive[a] & alive[b]] for c in (a, b)), w)
    assert again.all()


def test_line_fit_matches_eigenvectors(spark):
    x = RNG.normal(0, 9, 50)
    y = 0.4 * x + RNG.normal(0, 1, 50)
    w, v = np.linalg.eigh(np.cov(np.stack([x, y]), bias=True))
    row = S.line_fit(table(spark, x, y), ["run_id"]).first()
    assert row["aspect"] == pytest.approx(math.sqrt(w[1] / w[0])) and abs(row["ux"] * v[0, 1] + row["uy"] * v[1, 1]) == pytest.approx(1) and row["ux"] > 0


def test_near_candidates_equal_brute_force(monkeypatch):
    a, b = RNG.uniform(0, 50, (60, 2)), RNG.uniform(0, 50, (80, 2)).round(0)
    d = ((a[:, None] - b[None]) ** 2).sum(2)
    want = [(i, j) for i in range(60) for j in sorted(range(80), key=lambda j: (d[i, j], j))[:5] if d[i, j] < 64]
    got = near_candidates(*a.T, *b.T, 8.0, 5)
    assert list(zip(got[0].tolist(), got[1].tolist())) == want and np.allclose(got[2], d[got[0], got[1]])
    assert len(near_candidates(*a.T, *b[:0].T, 8.0, 5)[0]) == 0


# ---- folds


def walk(n=12, frames=30, gone=()):
    p = np.stack([np.arange(n) % 4 * 60.0, np.arange(n) // 4 * 60.0], 1)
    rows, k = [], 0
    for f in range(frames):
        p = p + RNG.normal(0, 0.5, p.shape)
        for q in range(n):
            if (q, f) not in gone:
                rows.append(("r", f, k, float(p[q, 0]), float(p[q, 1]), 6.0, q))
                k += 1
    return rows


def same_partition(a, b):
    pairs = set(zip(a, b))
    return len(pairs) == len(set(a)) == len(set(b))


@pytest.mark.parametrize(("hole", "kept"), [(0, True), (3, True), (4, False)])
def test_linker_keeps_identities_through_short_gaps(spark, hole, kept):
    rows = walk(gone={(2, f) for f in range(10, 10 + hole)})
    df = spark.createDataFrame([r[:6] for r in rows], "run_id string, frame int, id bigint, x double, y double, reach double")
    both = df.unionByName(df.withColumn("run_id", F.lit("s")))
    got = L.link_nearest(both, "id", 3).collect()
    for run in ("r", "s"):
        own = {r["id"]: r["particle"] for r in got if r["run_id"] == run}
        assert same_partition([own[r[2]] for r in rows], [r[6] for r in rows]) == kept


def serial_links(rows, memory):
    state, out = L.new_links(), {}
    for f in sorted({r[1] for r in rows}):
        now = [r for r in rows if r[1] == f]
        ids = L.link_step(state, *(np.array([r[c] for r in now]).astype(np.float32).astype(float) for c in (3, 4)), now[0][5], memory, np.array([r[2] for r in now]))
        out |= dict(zip([r[2] for r in now], ids.tolist()))
    return out


@pytest.mark.parametrize(("chunk", "warm"), [(1024, 32), (30, 4), (9, 1)])
def test_linker_in_chunks_equals_one_pass(spark, chunk, warm):
    """60 frames in 1, 2 and 7 chunks; crowded points that come and go, so that short warm-ups are wrong and chunks are done again."""
    p, rows, k = RNG.uniform(0, 60, (40, 2)), [], 0
    for f in range(60):
        p = np.clip(p + RNG.normal(0, 2.0, p.shape), 0, 60)
        for q in range(40):
            if RNG.random() < 0.8:
                rows.append(("r", 3 * f, k, float(p[q, 0]), float(p[q, 1]), 9.0))
                k += 1
    df = spark.createDataFrame(rows + [("s", *r[1:]) for r in rows[:300]], "run_id string, frame int, id bigint, x double, y double, reach double")
    got = L.link_nearest(df.repartition(6), "id", 3, chunk, warm).collect()
    assert len(got) == len(rows) + 300
    assert {r["id"]: r["particle"] for r in got if r["run_id"] == "r"} == serial_links(rows, 3)
    assert {r["id"]: r["particle"] for r in got if r["run_id"] == "s"} == serial_links(rows[:300], 3)
    assert L.link_nearest(df.where("false"), "id").count() == 0


def test_linker_does_not_age_over_empty_frames():
    state = L.new_links()
    a = L.link_step(state, np.array([1.0]), np.array([1.0]), 5.0, 0)
    b = L.link_step(state, np.array([1.5]), np.array([1.0]), 5.0, 0)
    assert a.tolist() == b.tolist() == [0]


def test_linker_grants_the_nearest_first():
    state = L.new_links()
    L.link_step(state, np.array([0.0, 3.0]), np.array([0.0, 0.0]), 5.0, 3)
    assert L.link_step(state, np.array([2.5, 6.0]), np.array([0.0, 0.0]), 5.0, 3).tolist() == [1, 2]


@pytest.mark.parametrize(("growth", "most"), [(0.0, 1e-9), (0.001, 0.5)])
def test_affine_flow_is_removed(spark, growth, most):
    # the field is evaluated at the later places, so growth leaves a rest of second order
    p0 = RNG.uniform(0, 100, (40, 2))
    rows = []
    for f in range(12):
        p = p0 * (1 + growth * f) + np.array([0.5, -0.2]) * f
        rows += [("r", f, q, float(p[q, 0]), float(p[q, 1]), 0.5) for q in range(40)]
    df = spark.createDataFrame(rows, "run_id string, frame int, particle bigint, x_um double, y_um double, dt double")
    got = L.correct_drift(df).collect()
    off = [abs(r["x_aff"] - p0[r["particle"], 0]) + abs(r["y_aff"] - p0[r["particle"], 1]) for r in got]
    assert len(got) == len(rows) and max(off) < most


def serial_drift(rows, least=20):
    """Frame after frame, each from the corrected frame before."""
    out, state = {}, None
    for f in sorted({r[1] for r in rows}):
        now = {r[2]: np.array(r[3:5]) for r in rows if r[1] == f}
        raw = dict(now)
        if state:
            before, at = state
            both = [q for q in now if q in before]
            gap = (f - at) * 0.5
            if len(both) >= least:
                a = np.array([[*before[q], 1.0] for q in both])
                v = [np.linalg.lstsq(a, np.array([(raw[q][k] - before[q][k]) / gap for q in both]), rcond=None)[0] for k in (0, 1)]
                now = {q: p - gap * np.array([np.dot([*p, 1.0], w) for w in v]) for q, p in raw.items()}
        state = (now, f)
        out |= {(f, q): p for q, p in now.items()}
    return out


def test_drift_by_matrices_equals_the_serial_fold(spark):
    p = RNG.uniform(0, 100, (40, 2))
    rows = []
    for f in [*range(9), 11, 12, 13]:
        p = p * 1.001 + np.array([0.3, -0.2]) + RNG.normal(0, 0.3, p.shape)
        rows += [("r", f, q, float(p[q, 0]), float(p[q, 1]), 0.5) for q in range(40) if RNG.random() < 0.9 or f == 4]
    rows = [r for r in rows if r[1] != 7 or r[2] < 10]
    df = spark.createDataFrame(rows, "run_id string, frame int, particle bigint, x_um double, y_um double, dt double")
    want = serial_drift(rows)
    got = {(r["frame"], r["particle"]): (r["x_aff"], r["y_aff"]) for r in L.correct_drift(df.repartition(7)).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(tuple(want[k]), abs=1e-8) for k in want)
    one = spark.createDataFrame([("s", 1, 1, 2.0, 3.0, 0.5), ("t", 1, 1, 2.0, 3.0, 0.0), ("t", 2, 1, 5.0, 3.0, 0.0)], df.schema)
    assert {(r["run_id"], r["frame"], r["x_aff"]) for r in L.correct_drift(one, least=1).collect()} == {("s", 1, 2.0), ("t", 1, 2.0), ("t", 2, 5.0)}


def test_boundaries_keep_their_names_and_fragments_join(spark):
    rows, k = [], 0
    for f in range(20):
        if f in (7, 8):
            continue
        for gb, (y0, slope) in enumerate(((50, 0.0), (200, 0.1))):
            for piece in (0, 1):
                for i in range(6):
                    x = piece * 80 + i * 10 + RNG.normal(0, 1)
                    rows.append(("r", f, 2 * gb + piece, k, x, y0 + slope * x + RNG.normal(0, 1), 4.0, True))
                    k += 1
    df = spark.createDataFrame(rows, "run_id string, frame int, gb bigint, id bigint, x double, y double, mis double, low boolean")
    settings = spark.createDataFrame([("r", 60.0, 60.0)], "run_id string, merge_gap double, max_off double")
    t = T.track_boundaries(df, settings).cache()
    assert t.count() == len(rows)
    names = {r["gb_id"]: r["n"] for r in t.groupBy("gb_id").agg(F.count_distinct("frame").alias("n")).collect()}
    assert names == {0: 18, 1: 18}
    lasting = B.lasting(t, 10).cache()
    scale = spark.createDataFrame([("r", 1.0, 0.5)], "run_id string, spacing double, px_um double")
    axes = B.pooled_axes(lasting).cache()
    cores = B.pooled_cores(lasting, axes, scale).cache()
    assert cores.count() == 18 * 24
    s = B.boundary_summary(cores, lasting, scale).cache()
    assert all(abs(r["D_um"] - 5) < 1 and abs(r["theta_frank_deg"] - 5.7) < 1.5 and r["theta_psi6_deg"] == pytest.approx(4) and r["n_frames"] == 18 for r in s.collect())
    f = B.fluctuations(cores, s)
    assert f.agg(F.sum("n")).first()[0] == 2 * 18 * 12 * 11 // 2 and f.agg(F.max("B_perp_um2")).first()[0] < 3
    assert B.peak_exponents(B.structure_factor(cores, s, 200), s).count() > 0
    assert B.normed_spacings(cores, s).count() == 2 * 18 * 11


def test_cores_closer_than_two_constants_are_one(spark):
    rows = [("r", 0, f, 10.0 * i + k, 5.0 + k, 4.0, True) for f in range(3) for i in range(6) for k in (0.0, 0.5)]
    m = spark.createDataFrame(rows, "run_id string, gb_id bigint, frame int, x double, y double, mis double, low boolean")
    scale = spark.createDataFrame([("r", 1.0, 1.0)], "run_id string, spacing double, px_um double")
    axes = B.pooled_axes(m)
    cores = B.pooled_cores(m, axes, scale)
    assert {r["n"] for r in cores.collect()} == {2} and cores.count() == 18
    s = B.boundary_summary(cores, m, scale).first()
    assert s["D_um"] == pytest.approx(10, rel=0.01) and s["n_dislocations"] == 6
    wide = B.boundary_summary(B.pooled_cores(m, axes, scale.withColumn("spacing", F.lit(50.0))), m, scale).first()
    assert wide["D_um"] is None and wide["theta_frank_deg"] is None and wide["n_dislocations"] == 1


def test_chains_are_one_to_one_and_bridge_gaps(spark):
    """Two parallel boundaries 100 px apart, one of them unseen for long; a third crosses them."""
    rows = []
    for f in range(40):
        for gb, y in enumerate((50.0, 150.0)):
            if not (gb == 1 and 10 <= f < 25) and not (gb == 0 and 12 <= f < 20):
                rows += [("r", f, gb, 10.0 * i, y + RNG.normal(0, 1), None, gb == 0) for i in range(12)]
        rows += [("r", f, 7, 60.0 + RNG.normal(0, 1), 20.0 * i, 20.0, False) for i in range(12)]
    df = spark.createDataFrame(rows, "run_id string, frame int, gb bigint, x double, y double, mis double, low boolean")
    settings = spark.createDataFrame([("r", 60.0)], "run_id string, max_off double")
    t = T.track_boundaries(df.repartition(5), settings)
    spans = sorted(tuple(r)[1:] for r in t.groupBy("gb_id").agg(F.min("frame"), F.max("frame"), F.count_distinct("frame")).collect())
    # 8 frames unseen are bridged, 15 are not
    assert spans == sorted([(0, 39, 32), (0, 9, 10), (25, 39, 15), (0, 39, 40)])
    assert T.track_boundaries(df.where("false"), settings).count() == 0


def test_pooled_band_shows_the_angle(spark):
    p = None
    for f in range(3):
        x, y = bicrystal(5.0)
        one = table(spark, x, y, frame=f, first=100_000 * f)
        p = one if p is None else p.unionByName(one)
    s = S.structure_points(p, S.delaunay_edges(p, "id").cache(), "id").cache()
    # cores along the seam x = 200, a lattice constant over the angle apart
    m = spark.createDataFrame([("r", 0, f, 200.0, 150.0 + 114.6 * i, 4.0, True) for f in range(3) for i in range(5)], "run_id string, gb_id bigint, frame int, x double, y double, mis double, low boolean")
    scale = spark.createDataFrame([("r", 10.0, 0.1)], "run_id string, spacing double, px_um double")
    axes = B.pooled_axes(m).cache()
    summary = B.boundary_summary(B.pooled_cores(m, axes, scale), m, scale).cache()
    assert summary.first()["theta_frank_deg"] == pytest.approx(5.0, abs=0.01)
    got = B.pooled_misorientation(m, axes, summary, s, scale).collect()
    assert len(got) == 1 and got[0]["theta_grains_deg"] == pytest.approx(5.0, abs=0.3)
