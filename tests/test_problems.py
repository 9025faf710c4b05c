import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mesoflow.operators import compaction as C
from mesoflow.operators import proximity as X
from mesoflow.operators import quantiles as Q
from mesoflow.operators.regrid import one_per_slot, regular_grid
from mesoflow.operators.spikes import Field, flag_readings, robust_pca

RNG = np.random.default_rng(7)


# ---- 1: spikes


def brute_flags(readings, field):
    """(rec, field) by the plain rules; readings: source -> [(order, rec, value)]."""
    out = set()
    for rows in readings.values():
        rows = sorted(rows)
        there = [(r, v) for _, r, v in rows if v is not None and not math.isnan(v)]
        v = np.array([x for _, x in there], float)
        rec = [r for r, _ in there]
        bad = np.isinf(v) | (v < 0) | ((v <= 0) if field.positive else False)
        out |= {rec[i] for i in np.flatnonzero(bad)}
        i = 0
        while i < len(v):
            j = i
            while j < len(v) and v[j] == v[i]:
                j += 1
            if j - i >= field.stuck:
                out |= set(rec[i:j])
            i = j
        ok = [(r, x) for (r, x), b in zip(there, bad) if not b]
        w = np.array([x for _, x in ok])
        if field.spike == "ratio":
            if len(w):
                m = np.median(w)
                out |= {r for r, x in ok if x > field.times * m or x * field.times < m}
        elif len(w) >= field.enough:
            limit = field.times * np.median(np.abs(np.diff(w)))
            for a in range(1, len(w) - 1):
                for b in (a + 1, a + 2):
                    if b < len(w):
                        s, p, n = w[a:b], w[a - 1], w[b]
                        if ((s - p > limit).all() and (s - n > limit).all()) or ((p - s > limit).all() and (n - s > limit).all()):
                            out |= {r for r, _ in ok[a:b]}
    return out


def odd_series(kind):
    n, rec, rows = 400, 0, {}
    for source in ("a", "b", "c"):
        base = RNG.lognormal(8, 0.3, n) if kind == "ratio" else 100 + np.cumsum(RNG.normal(0, 0.5, n))
        base[50:60] = base[50]
        base[200] *= 30
        base[210:212] += 400
        base[300:] += 20
        base[5], base[6] = np.inf, -3
        base[7] = np.nan
        rows[source] = []
        for i in range(n):
            rec += 1
            rows[source].append((i, rec, None if i % 97 == 13 else float(base[i])))
    rows["short"] = [(i, 10_000 + i, float(i % 3)) for i in range(9)]
    return rows


@pytest.mark.parametrize("block", [65_536, 37, 5])
@pytest.mark.parametrize("kind", ["ratio", "jump"])
def test_flags_equal_brute_force_for_any_block(spark, kind, block):
    f = Field("v", positive=kind == "ratio", stuck=8 if kind == "ratio" else 6, spike=kind, times=6.0 if kind == "ratio" else 15.0, enough=1 if kind == "ratio" else 20, width=16 if kind == "ratio" else 8)
    rows = odd_series(kind)
    df = spark.createDataFrame([(s, o, r, v, "x", 1) for s, rs in rows.items() for o, r, v in rs], "src string, ord bigint, rec bigint, v float, _tag string, _block int")
    rows = {s: [(o, r, v if v is None else float(np.float32(v))) for o, r, v in rs] for s, rs in rows.items()}
    got = {r["rec_id"] for r in flag_readings(df, ["src"], ["ord", "rec"], "rec", [f], block=block).where("kind & 7 > 0").collect()}
    assert got == brute_flags(rows, f)


@pytest.mark.parametrize("identity", ["all sparse", "all low"])
def test_the_split_decides_what_is_off(spark, monkeypatch, identity):
    """Readings that follow their source's pattern are normal, a small departure from it is not; without the split neither is seen."""
    from mesoflow.operators import spikes

    wave = np.outer(np.ones(16), np.sin(np.arange(16) / 16 * 2 * np.pi)).ravel() * 1.2
    base = np.exp(8 + wave + RNG.normal(0, 0.01, 256))
    base[100] *= 1.5
    df = spark.createDataFrame([("a", i, i, float(v)) for i, v in enumerate(base)], "src string, ord bigint, rec bigint, v double")
    f = Field("v", positive=True)
    off = lambda: {r["rec_id"]: r["score"] for r in flag_readings(df, ["src"], ["ord", "rec"], "rec", [f]).where("kind & 8 > 0").collect()}
    found = off()
    assert 100 in found and len(found) < 8
    monkeypatch.setattr(spikes, "robust_pca", (lambda x: (np.zeros_like(x), x)) if identity == "all sparse" else (lambda x: (x, np.zeros_like(x))))
    assert 100 not in off()


def test_flags_of_nothing(spark):
    f = [Field("v")]
    empty = spark.createDataFrame([], "src string, ord bigint, rec bigint, v double")
    assert flag_readings(empty, ["src"], ["ord", "rec"], "rec", f).count() == 0
    blank = spark.createDataFrame([(None, 1, 1, 5.0), ("a", None, 2, None), ("a", 2, 3, float("nan"))], empty.schema)
    assert flag_readings(blank, ["src"], ["ord", "rec"], "rec", f).count() == 0


def test_robust_pca_separates():
    low = np.outer(RNG.normal(size=16), RNG.normal(size=16))
    spikes = np.zeros((16, 16))
    spikes[3, 5], spikes[10, 2] = 8.0, -9.0
    l, s = robust_pca((low + spikes)[None])
    assert np.allclose(l + s, low + spikes)
    assert abs(s[0, 3, 5] - 8) < 0.5 and abs(s[0, 10, 2] + 9) < 0.5
    assert np.abs(np.delete(s.ravel(), [3 * 16 + 5, 10 * 16 + 2])).max() < 0.5


# ---- 2: compaction


def files(spark, rows):
    t = "run_id string, file_id bigint, written_at timestamp, recs array<struct<frame int, x float, y float, mass float, ecc float, signal float>>, part int, task int"
    return spark.createDataFrame(rows, t)


def rec(frame, x=1.0):
    return (frame, float(x), 0.0, 1.0, 0.1, 2.0)


def random_files():
    t0 = dt.datetime(2025, 1, 1)
    rows = []
    for i in range(120):
        run = "hot" if i % 3 else f"r{i % 5}"
        frames = sorted(RNG.integers(0, 12, RNG.integers(0, 5)).tolist())
        rows.append((run, i, t0 + dt.timedelta(hours=int(RNG.integers(0, 6))), [rec(f, i) for f in frames for _ in range(2)], 0, None))
    rows.append(("r0", 900, t0, None, 0, None))
    return rows


@pytest.mark.parametrize("span", [256, 3])
def test_superseded_equals_brute_force(spark, monkeypatch, span):
    monkeypatch.setattr(C, "SPAN", span)
    rows = random_files()
    best, all_ = {}, set()
    for run, fid, at, recs, *_ in rows:
        for f in {r[0] for r in recs or []}:
            all_.add((run, f, fid))
            best[run, f] = max(best.get((run, f), (at, fid)), (at, fid))
    want = {k for k in all_ if best[k[0], k[1]][1] != k[2]}
    for parts in (1, 7, 60):
        plan = C.merge_plan(files(spark, rows + rows[:9]).repartition(parts))
        got = [tuple(r) for r in C.superseded(plan).collect()]
        assert sorted(got) == sorted(want)
        assert sorted((r["run_id"], r["frame"], r["file_id"]) for r in C.kept(plan).collect()) == sorted(all_ - want)


def test_the_merge_brings_the_versions_of_a_key_together(spark, monkeypatch):
    """Without the merge, runs one after another, equal keys do not meet and the result is wrong."""
    from mesoflow.operators import compaction

    rows = random_files()
    n = C.superseded(C.merge_plan(files(spark, rows))).count()
    monkeypatch.setattr(compaction, "_merge", lambda *runs, key: (b for r in runs for b in r))
    assert C.superseded(C.merge_plan(files(spark, rows))).count() < n


@pytest.mark.parametrize("target", [600, 1 << 27])
def test_consolidated_files_hold_each_group_once(spark, tmp_path, target):
    rows = random_files()
    out = str(tmp_path / "merged")
    meta = C.consolidate(files(spark, rows + rows[:9]), out, ["x", "y", "mass", "ecc", "signal"], target_bytes=target).collect()
    got = sorted((r["run_id"], r["frame"], r["x"]) for r in spark.read.parquet(out).collect())
    best = {}
    for run, fid, at, recs, *_ in rows:
        for r in recs or []:
            k = (run, r[0])
            v = (at, fid)
            if k not in best or best[k][0] < v:
                best[k] = (v, [])
            if best[k][0] == v:
                best[k][1].append(r[1])
    want = sorted((k[0], k[1], x) for k, (_, xs) in best.items() for x in xs)
    assert got == want
    assert sum(m["n_rows"] for m in meta) == len(want)
    assert (len(meta) == 1) == (target > 1 << 20)
    import os

    assert {m["file"]: m["bytes"] for m in meta} == {f: os.path.getsize(f"{out}/{f}") for f in os.listdir(out) if f.endswith(".parquet")}
    ordered = sorted(((m["run_id_min"], m["frame_min"]), (m["run_id_max"], m["frame_max"])) for m in meta)
    assert all(lo <= hi for lo, hi in ordered) and all(a[1] <= b[0] for a, b in zip(ordered, ordered[1:]))


def test_compaction_of_nothing_of_odd_and_of_real_files(spark, tmp_path):
    from mesoflow.sources.smallfiles import FIELDS, read_small_files

    assert C.superseded(C.merge_plan(files(spark, []))).count() == 0
    assert C.merged_records(files(spark, []), FIELDS).count() == 0
    t = dt.datetime(2025, 1, 1)
    odd = files(spark, [("a", 1, t, [rec(None), rec(5), rec(2), rec(5, 9)], 0, None), ("a", 2, None, [rec(5, 7), rec(None, 7)], 0, None), (None, 3, t, [rec(5)], 0, None), ("a", None, t, [rec(5)], 0, None)])
    assert sorted(tuple(r) for r in C.superseded(C.merge_plan(odd)).select("file_id", F.coalesce("frame", F.lit(-1))).collect()) == [(2, -1), (2, 5)]
    got = C.merged_records(odd, FIELDS).select(F.coalesce("run_id", F.lit("")), F.coalesce("frame", F.lit(-1)), "x").collect()
    assert sorted(map(tuple, got)) == [("", 5, 1.0), ("a", -1, 1.0), ("a", 2, 1.0), ("a", 5, 1.0), ("a", 5, 9.0)]
    src = str(tmp_path / "small")
    data = spark.createDataFrame([("a", *rec(f)) for f in range(30)], "run_id string, frame int, x float, y float, mass float, ecc float, signal float")
    data.repartition(10).write.partitionBy("run_id").parquet(src)
    small = read_small_files(spark, src)
    assert small.select("file_id").distinct().count() == 10
    C.consolidate(small, str(tmp_path / "one"), FIELDS)
    assert spark.read.parquet(str(tmp_path / "one")).count() == 30


def test_misfit_runs(spark):
    meta = spark.createDataFrame([("a", 3, 3), ("b", 3, 4), ("c", 2, None), ("d", None, None), ("e", 1, 0)], "run_id string, n_chunks int, n_chunks_merged int")
    f = spark.createDataFrame([("a", 0), ("a", 1), ("a", 2), ("a", 2), ("b", 0), ("b", None), ("c", 0)], "run_id string, task int")
    got = {r["run_id"]: r["tasks_missing"] for r in C.chunk_check(meta, f).collect()}
    assert got == {"b": 2, "c": 1}


# ---- 3: percentiles


@pytest.mark.parametrize("every", [Q.RANGE, 7, 1])
def test_percentiles_are_exact(spark, every):
    data = {"hot": RNG.normal(0, 10, 900).round(1), "b": RNG.normal(0, 1, 40), None: np.array([1.0, 1.0, 2.0])}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [("hot", None), ("b", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r["g"], r["p"]): (r["value"], r["n_rows"]) for r in Q.exact_percentiles(df, ["g"], "v", [0.0, 0.1, 0.5, 0.9, 1.0], every=every).collect()}
    for k, vs in data.items():
        s = np.sort(vs)
        for p in (0.0, 0.1, 0.5, 0.9, 1.0):
            assert got[k, p] == (s[max(1, math.ceil(round(p * len(s), 6))) - 1], len(s))
    med = {r["g"]: r["median"] for r in Q.exact_medians(df, ["g"], "v", every=every).collect()}
    lin = {r["g"]: r["q"] for r in Q.linear_percentiles(df, ["g"], "v", {"q": 0.37}, every=every).collect()}
    for k, vs in data.items():
        assert med[k] == pytest.approx(np.median(vs), abs=1e-12)
        assert lin[k] == pytest.approx(np.percentile(vs, 37), abs=1e-9)


def test_octaves_give_the_same_medians(spark):
    v = {"a": np.abs(RNG.normal(0, 1, 301)), "b": np.r_[np.zeros(40), RNG.lognormal(3, 4, 61)], "c": np.array([2.0, 4.0])}
    df = spark.createDataFrame([(k, float(x)) for k, xs in v.items() for x in xs], "g string, v double")
    got = {r["g"]: r["median"] for r in Q.exact_medians(df, ["g"], "v", every=0).collect()}
    assert got == {k: pytest.approx(np.median(xs)) for k, xs in v.items()}


def test_states_combine_and_keep_their_error(spark):
    v = RNG.lognormal(5, 2, 600)
    df = spark.createDataFrame([("a", i % 4, float(x)) for i, x in enumerate(v)], "g string, day int, v double")
    whole = Q.exact_percentiles(df, ["g"], "v", [0.25, 0.5, 0.99])
    for error in (0.0, 0.01):
        days = [Q.value_counts(df.where(f"day = {d}"), ["g"], "v", error) for d in range(4)]
        state = days[0]
        for d in days[1:]:
            state = state.unionByName(d)
        got = {r["p"]: r["value"] for r in Q.percentiles_of_counts(Q.combine(state, ["g"]), ["g"], [0.25, 0.5, 0.99]).collect()}
        for r in whole.collect():
            assert abs(got[r["p"]] - r["value"]) <= (error + 1e-12) * r["value"]
    assert Q.exact_percentiles(df.where("false"), ["g"], "v", [0.5]).count() == 0


# ---- 4: grid


@pytest.mark.parametrize("block", [8192, 4])
def test_grid_equals_brute_force(spark, block):
    rows, want = [], {}
    for s in ("a", "b"):
        slots = sorted(RNG.choice(60, 18, replace=False).tolist())
        xs = RNG.normal(size=18).tolist()
        rows += [(s, k, x) for k, x in zip(slots, xs)]
        for k in range(slots[0], slots[-1] + 1):
            i = max(j for j, q in enumerate(slots) if q <= k)
            if slots[i] == k:
                want[s, k] = (True, xs[i])
            else:
                a, b = slots[i], slots[i + 1]
                want[s, k] = (False, xs[i] + (xs[i + 1] - xs[i]) * (k - a) / (b - a) if b - a <= 5 else None)
    rows += [("one", 3, 1.0), ("none", None, 2.0), ("nan", 4, float("nan")), (None, 4, 1.0)]
    want["one", 3] = (True, 1.0)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "s string, k bigint, v double, _block int, slot string")
    got = {(r["s"], r["slot"]): (r["is_reading"], r["filled"]) for r in regular_grid(df, ["s"], "k", "v", 5, block).collect()}
    assert got.keys() == want.keys()
    for k, (here, x) in want.items():
        assert got[k][0] == here and (got[k][1] is None if x is None else got[k][1] == pytest.approx(x))


def test_one_reading_stands_for_a_slot(spark):
    df = spark.createDataFrame([("a", 1, 7, 5.0, 0.3), ("a", 1, 5, 6.0, 0.1), ("a", 1, 4, 8.0, 0.1), ("a", 1, 4, 8.0, 0.1), ("a", 2, 9, 1.0, None)], "s string, k bigint, rec bigint, v double, off double")
    assert {tuple(r) for r in one_per_slot(df, ["s"], "k", "rec", ["v"], "off").collect()} == {("a", 1, 8.0), ("a", 2, 1.0)}


# ---- 5: proximity


def cloud(n=300):
    rows = [(i, "a" if i % 3 else "b", float(x), float(y)) for i, (x, y) in enumerate(RNG.uniform(-40, 60, (n, 2)))]
    return rows + [(n, "a", 5.0, 5.0), (n + 1, "a", 5.0, 5.0), (n + 2, "a", 9.0, 5.0), (n + 3, None, 5.0, 5.0), (n + 4, "a", None, 1.0), (n + 5, "a", float("inf"), 1.0), (n + 6, "a", 1e12, 1e12), (n + 7, "a", 1e12, 1e12)]


def brute_pairs(rows, r):
    p = [(i, g, x, y) for i, g, x, y in rows if g is not None and x is not None and math.isfinite(x)]
    return {(a[0], b[0]) for a in p for b in p if a[0] < b[0] and a[1] == b[1] and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= r * r}


@pytest.mark.parametrize("radius", [4.0, 17.5])
def test_near_pairs_equal_brute_force(spark, radius):
    rows = cloud()
    df = spark.createDataFrame([(*r, 1) for r in rows], "rec bigint, g string, x double, y double, _tile int")
    assert {(r["a"], r["b"]) for r in X.near_pairs(df, ["g"], "rec", radius).collect()} == brute_pairs(rows, radius)
    assert X.near_pairs(df.where("false"), ["g"], "rec", radius).count() == 0


def test_nearest_equals_brute_force(spark):
    rows = [r for r in cloud(80) if r[1] and r[2] is not None and math.isfinite(r[2]) and r[2] < 1e6]
    df = spark.createDataFrame(rows, "rec bigint, g string, x double, y double")
    got = {(r["a"], r["rank"]): r["b"] for r in X.nearest(df, ["g"], "rec", 3).collect()}
    for i, g, x, y in rows:
        near = sorted(((x - u) ** 2 + (y - v) ** 2, j) for j, h, u, v in rows if h == g and j != i)[:3]
        assert [got[i, k + 1] for k in range(len(near))] == [j for _, j in near]


def test_points_in_regions(spark):
    rows = cloud(200)
    ring = [[-20.0, -10.0], [30.0, -25.0], [45.0, 20.0], [10.0, 5.0], [-15.0, 40.0]]
    df = spark.createDataFrame(rows, "rec bigint, g string, x double, y double")
    reg = spark.createDataFrame([("a", ring), ("b", ring[:2]), (None, None)], "g string, ring array<array<double>>")

    def inside(x, y):
        odd = False
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
        return odd

    want = {i for i, g, x, y in rows if g == "a" and x is not None and math.isfinite(x) and inside(x, y)}
    assert {r["rec"] for r in X.points_in_regions(df, reg, ["g"], "rec", "ring", 4.0).collect()} == want


def test_far_regions_and_thin_ones(spark):
    far = [[2e7 - 5, 2e7 - 5], [2e7 + 5, 2e7 - 5], [2e7 + 5, 2e7 + 5], [2e7 - 5, 2e7 + 5]]
    thin = [[0.0, 0.0], [900.0, 880.0], [900.0, 900.0]]
    reg = spark.createDataFrame([("a", far), ("b", thin), ("c", [[0.0, 0.0], [1.0, None], [2.0, 2.0]])], "g string, ring array<array<double>>")
    pts = [(1, "a", 2e7, 2e7), (2, "a", 2e7 + 9, 2e7), (3, "b", 450.0, 445.0), (4, "b", 450.0, 300.0), (5, "b", 899.0, 885.0), (6, "c", 1.0, 1.0)]
    df = spark.createDataFrame(pts, "rec bigint, g string, x double, y double")
    assert {r["rec"] for r in X.points_in_regions(df, reg, ["g"], "rec", "ring", 4.0).collect()} == {1, 3, 5}
    cover = X.region_cover(reg.where("g = 'b'"), ["g"], "ring", 4.0).count()
    assert cover < 150  # its bounding box has 29 x 29 tiles


def test_infinite_times_take_the_frame(spark):
    from mesoflow.sources.runs import with_slots

    t = spark.createDataFrame([("a", 7, float("inf")), ("a", 8, None), ("a", 9, float("nan")), ("a", 5, 2.4)], "run_id string, frame int, t double")
    meta = spark.createDataFrame([("a", 2.0, 3)], "run_id string, dt double, frame_start int")
    assert [r["slot"] for r in with_slots(t, meta).orderBy("frame").collect()] == [1, 4, 5, 6]


def test_building_a_plan_starts_no_job(spark, sf_dir):
    from mesoflow.plans import registry

    q = registry.queries()
    seen = spark.sparkContext.statusTracker()
    for name in ("p1_found", "p2_found", "p3_percentiles", "p4_found", "p5_found", "p5_in_roi", "msd", "mad_outlier_filter", "otsu_256", "auto_max_step", "sweep_minmass_per_run", "chunk_assignment"):
        for table in ("detections", "tracks", "job_meta", "chunk_files"):
            spark.read.parquet(f"{sf_dir}/{table}.parquet")
        spark.sparkContext.setJobGroup(f"plan {name}", name)
        q[name](spark, sf_dir)
        jobs = seen.getJobIdsForGroup(f"plan {name}")
        # the schemas of the tables are read by one task each, nothing more
        assert all(s is None or s.numTasks <= 1 for j in jobs for i in seen.getJobInfo(j).stageIds for s in [seen.getStageInfo(i)]), name
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
