"""Linking and drift correction over the frames of a run, and greedy choices within an image.

Both are sequential in time by their rules, and neither keeps a run in one task: chunks of frames are linked at once and
checked against each other, and drift correction only folds one small matrix per frame.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mesoflow.operators.arrowgroups import whole_groups
from mesoflow.operators.geometry import close_pairs, greedy_by_weight, near_candidates
from mesoflow.operators.groupmap import map_groups, spread
from mesoflow.session import ensure_checkpoint_dir


def new_links() -> dict:
    return {"id": np.zeros(0, np.int64), "rec": np.zeros(0, np.int64), "x": np.zeros(0), "y": np.zeros(0), "missing": np.zeros(0, np.int64), "next": 0}


def link_step(state: dict, x: np.ndarray, y: np.ndarray, reach: float, memory: int, rec: np.ndarray | None = None, most: int = 5, named: bool = False) -> np.ndarray:
    """Identities of one frame's points; the state moves on.

    Each live particle proposes its ``most`` nearest points closer than ``reach``;
    proposals are granted nearest first (ties: the smaller last ``rec`` of the particle, then point order). Who finds none is kept at its last
    place for up to ``memory`` frames; points without a particle start new ones in their order. With ``named`` a new
    particle is called by its first ``rec``, else by the next number. The state is the set of the live, so where it
    is equal all that follows is equal.
    """
    n_live, n = len(state["id"]), len(x)
    rec = np.arange(n) if rec is None else rec
    owner = np.full(n, -1)
    taken = np.zeros(n_live, bool)
    if n_live and n:
        live, point, dist = near_candidates(state["x"], state["y"], x, y, reach, most)
        for i in np.lexsort((point, state["rec"][live], dist)):
            if not taken[live[i]] and owner[point[i]] < 0:
                taken[live[i]], owner[point[i]] = True, live[i]
    new = owner < 0
    ids = np.empty(n, np.int64)
    ids[~new] = state["id"][owner[~new]]
    ids[new] = rec[new] if named else state["next"] + np.arange(new.sum())
    kept = ~taken & (state["missing"] + 1 <= memory)
    for c, now in (("x", x), ("y", y), ("id", ids), ("rec", rec)):
        state[c] = np.concatenate([now, state[c][kept]])
    state["missing"] = np.concatenate([np.zeros(n, np.int64), state["missing"][kept] + 1])
    state["next"] += int(new.sum())
    return ids


def _link_chunk(memory: int):
    """Links of the frames of a chunk after its warm-up, and the live particles before its first and after its last frame."""
    names = ["run_id", "chunk", "kind", "frame", "rec", "name", "missing"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, at, warm = new_links(), None, True
        out: list[tuple] = []

        def live(kind: int) -> None:
            n = len(state["id"])
            out.append((at, np.full(n, kind), np.zeros(n, np.int64), state["rec"], state["id"], state["missing"]))

        def made() -> pa.RecordBatch:
            n = [len(o[1]) for o in out]
            cols = [pa.array([v for (v, _), *_ in out], pa.string()).take(pa.array(np.repeat(np.arange(len(out)), n))), pa.array(np.repeat(np.array([c for (_, c), *_ in out], np.int64), n))]
            cols += [pa.array(np.concatenate([np.asarray(o[k]) for o in out]).astype(np.int64)).cast(t) for k, t in ((1, pa.int32()), (2, pa.int32()), (3, pa.int64()), (4, pa.int64()), (5, pa.int32()))]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, names)

        for t, gid in whole_groups(batches, ["run_id", "chunk", "frame"]):
            cols = {n: t.column(n).combine_chunks().to_numpy(zero_copy_only=False) for n in t.column_names}
            starts = np.flatnonzero(np.r_[True, gid[1:] != gid[:-1]])
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(gid)], strict=True):
                here = (cols["run_id"][a], int(cols["chunk"][a]))
                if here != at:
                    if at is not None and not warm:
                        live(2)
                    state, at, warm = new_links(), here, True
                real = not cols["warm"][a]
                if real and warm:
                    live(1)
                    warm = False
                x, y = (cols[c][a:b].astype(np.float32).astype(np.float64) for c in ("x", "y"))
                ids = link_step(state, x, y, float(cols["reach"][a]), memory, cols["rec"][a:b], named=True)
                if real:
                    out.append((at, np.zeros(b - a), cols["frame"][a:b], cols["rec"][a:b], ids, np.zeros(b - a)))
            if out:
                yield made()
        if at is not None and not warm:
            live(2)
            yield made()

    return run


def link_nearest(points: DataFrame, rec: str, memory: int = 3, chunk: int = 1024, warm: int = 32) -> DataFrame:
    """``run_id, frame, rec, particle``: points (``rec, x, y, reach``) linked over a run's frames; particles are numbered from 0 in order of appearance.

    ``reach`` is the run's search range. Positions are taken as float. Frames
    without points do not age the memory, as they are not seen.

    A run is cut into chunks of ``chunk`` frames that are linked at once, each after ``warm`` frames of the one before
    to find out which particles are live at its start. Linking depends on the past by the set of live
    particles alone, so a chunk is right if that set is the one its predecessor ends with. Chunks for which it is not are done again with four
    times the warm-up (at last from the run's first frame), until all agree: the result is that of one pass, however the
    run is cut. Names are then carried from chunk to chunk by pointer doubling.
    """
    spark = points.sparkSession
    ensure_checkpoint_dir(spark)
    p = points.select("run_id", "frame", F.col(rec).cast("bigint").alias("rec"), "x", "y", F.col("reach").cast("double").alias("reach")).where("run_id is not null and frame is not null")
    frames = p.select("run_id", "frame").distinct()
    # one row per frame of a run
    frames = frames.withColumn("_k", F.row_number().over(Window.partitionBy("run_id").orderBy("frame")) - 1)
    p = p.join(frames, ["run_id", "frame"]).checkpoint()

    def linked(warm: int, only: DataFrame | None) -> DataFrame:
        own = F.floor(F.col("_k") / chunk)
        x = p.withColumn("chunk", F.explode(F.sequence(own, F.floor((F.col("_k") + warm) / chunk)))).withColumn("warm", F.col("chunk") > own)
        x = x if only is None else x.join(only, ["run_id", "chunk"], "left_semi")
        x = spread(x.drop("_k"), ["run_id", "chunk"]).sortWithinPartitions("run_id", "chunk", "frame", "rec")
        return x.mapInArrow(_link_chunk(memory), "run_id string, chunk bigint, kind int, frame int, rec bigint, name bigint, missing int").checkpoint()

    key = ["run_id", "chunk"]
    out = linked(warm, None)
    while True:
        live = lambda kind, name: out.where(f"kind = {kind}").groupBy(*key).agg(F.struct(F.count(F.lit(1)), F.bit_xor(F.xxhash64("rec", "missing"))).alias(name))
        before = live(2, "_end").withColumn("chunk", F.col("chunk") + 1)
        later = out.where("kind = 0 and chunk > 0").select(*key).distinct()
        bad = later.join(live(1, "_start"), key, "left").join(before, key, "left").where(~F.col("_start").eqNullSafe(F.col("_end"))).select(*key).checkpoint()
        if bad.isEmpty():
            break
        warm *= 4
        out = out.join(bad, key, "left_anti").unionByName(linked(warm, bad)).checkpoint()
    start, end = (out.where(f"kind = {kind}").select("run_id", F.col("chunk"), "rec", F.col("name").alias(name)) for kind, name in ((1, "name"), (2, "up")))
    end = end.withColumn("chunk", F.col("chunk") + 1)
    up = start.join(end, [*key, "rec"]).select(*key, "name", (F.col("chunk") - 1).alias("_c"), F.col("up").alias("_n")).checkpoint()
    while True:
        far = up.select("run_id", F.col("chunk").alias("_c"), F.col("name").alias("_n"), F.col("_c").alias("_c2"), F.col("_n").alias("_n2"))
        new = up.join(far, ["run_id", "_c", "_n"], "left").select(*key, "name", F.coalesce("_c2", "_c").alias("_c"), F.coalesce("_n2", "_n").alias("_n"), F.col("_c2").isNotNull().alias("_moved")).checkpoint()
        up = new.drop("_moved")
        if new.where("_moved").isEmpty():
            break
    found = out.where("kind = 0").join(up.select(*key, "name", "_n"), [*key, "name"], "left").select("run_id", "frame", "rec", F.coalesce("_n", "name").alias("root"))
    # a particle's number: those that began in earlier frames, and the place among those of its own
    first = found.where("rec = root").withColumn("_at", F.row_number().over(Window.partitionBy("run_id", "frame").orderBy("rec")) - 1)
    per = first.groupBy("run_id", "frame").agg(F.count(F.lit(1)).alias("_new"))
    per = per.select("run_id", "frame", F.coalesce(F.sum("_new").over(Window.partitionBy("run_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    number = first.join(per, ["run_id", "frame"]).select("run_id", "root", (F.col("_at") + F.col("_before")).cast("bigint").alias("particle"))
    return found.join(number, ["run_id", "root"]).select("run_id", "frame", F.col("rec").alias(rec), "particle")


def correct_drift(tracks: DataFrame, dt: str = "dt", least: int = 20) -> DataFrame:
    """``run_id, frame, particle, x_aff, y_aff``: tracks less the affine flow of the frames before.

    From each present frame to the next the velocity field v = a + b x + c y is fitted to the
    shared particles, the earlier ones corrected, the later ones raw, and its displacement at the later places is taken
    off. Pairs of frames with under ``least`` shared particles, or all of them on a line, change nothing.

    A correction is affine, and least squares commute with affine maps: if C is the fitted map from the raw frame f to
    the raw frame f + 1 and T the correction at f, then the fit from corrected to raw is C T^-1, and the correction at f + 1 is
    2 - C T^-1. So the fits are sums over particles, all frames at once, and only one 2 x 3
    matrix per frame is folded along a run. Where T cannot be inverted the next frame begins anew.
    """
    now, nxt = (tracks.select("run_id", "particle", F.col("frame").alias(f), F.col("x_um").cast("double").alias(x), F.col("y_um").cast("double").alias(y)) for f, x, y in (("frame", "x", "y"), ("_next", "u", "v")))
    frames = tracks.groupBy("run_id", "frame").agg((F.max(dt) > 0).alias("_timed"))
    follow = frames.withColumn("_next", F.lead("frame").over(Window.partitionBy("run_id").orderBy("frame")))
    j = now.join(follow.where("_timed and _next is not null").select("run_id", "frame", "_next"), ["run_id", "frame"]).join(nxt, ["run_id", "particle", "_next"])
    mean = {f"m{c}": F.avg(c) for c in "xyuv"} | {p + q: F.avg(F.col(p) * F.col(q)) for p, q in ("xx", "xy", "yy", "xu", "yu", "xv", "yv")}
    m = j.groupBy("run_id", F.col("_next").alias("frame")).agg(F.count(F.lit(1)).alias("_n"), *[e.alias(k) for k, e in mean.items()])
    table = frames.select("run_id", "frame").join(m.where(F.col("_n") >= least), ["run_id", "frame"], "left")

    def fold(g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        n = len(g["frame"])
        out = np.zeros((n, 6))
        before = np.eye(3)
        for k in range(n):
            t = np.eye(3)
            c = {p + q: g[p + q][k] - g["m" + p][k] * g["m" + q][k] for p, q in ("xx", "xy", "yy", "xu", "yu", "xv", "yv")}
            det = c["xx"] * c["yy"] - c["xy"] ** 2
            if det > 1e-9 * max(c["xx"] * c["yy"], 1e-300) and abs(np.linalg.det(before)) > 1e-12:
                step = np.eye(3)
                for row, (to, p, q) in enumerate((("u", "xu", "yu"), ("v", "xv", "yv"))):
                    a, b = (c[p] * c["yy"] - c[q] * c["xy"]) / det, (c[q] * c["xx"] - c[p] * c["xy"]) / det
                    step[row] = a, b, g["m" + to][k] - a * g["mx"][k] - b * g["my"][k]
                t[:2] = 2 * np.eye(3)[:2] - (step @ np.linalg.inv(before))[:2]
            out[k], before = t[:2].ravel(), t
        return {"frame": g["frame"], **{f"t{i}": out[:, i] for i in range(6)}}

    # one row per frame of a run
    maps = map_groups(table.withColumnRenamed("frame", "_f").withColumn("frame", F.col("_f")).drop("_f"), ["run_id"], ["frame"], fold, "frame int, " + ", ".join(f"t{i} double" for i in range(6)))
    x, y = F.col("x_um").cast("double"), F.col("y_um").cast("double")
    put = lambda r: F.col(f"t{3 * r}") * x + F.col(f"t{3 * r + 1}") * y + F.col(f"t{3 * r + 2}")
    return tracks.select("run_id", "frame", "particle", "x_um", "y_um").join(maps, ["run_id", "frame"]).select("run_id", "frame", "particle", put(0).alias("x_aff"), put(1).alias("y_aff"))


def suppress_close(points: DataFrame, rec: str, separation: float, weight: str = "mass") -> DataFrame:
    """``run_id, frame, rec`` of the points left when of each pair within ``separation`` the lighter goes, heaviest pairs first (per image)."""

    def one(g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        i, j = close_pairs(g["x"], g["y"], separation)
        return {rec: g[rec][greedy_by_weight(i, j, g[weight])]}

    return map_groups(points.select("run_id", "frame", rec, "x", "y", weight), ["run_id", "frame"], [rec], one, f"{rec} bigint")


def dedupe_in_order(points: DataFrame, rec: str, radius: float) -> DataFrame:
    """``run_id, frame, rec`` of the points left when each kept point, in ``rec`` order, removes the later ones within ``radius``."""

    def one(g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        i, j = close_pairs(g["x"], g["y"], radius)
        alive = np.ones(len(g["x"]), bool)
        for k in np.lexsort((j, i)):
            if alive[i[k]]:
                alive[j[k]] = False
        return {rec: g[rec][alive]}

    return map_groups(points.select("run_id", "frame", rec, "x", "y"), ["run_id", "frame"], [rec], one, f"{rec} bigint")
