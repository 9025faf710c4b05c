"""Queries on structure, linking and boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mesoflow.operators import boundary_stats as B
from mesoflow.operators import folds as L
from mesoflow.operators import series as R
from mesoflow.operators import structure as S
from mesoflow.operators.boundary_tracks import track_boundaries
from mesoflow.operators.correlation import default_range, pair_counts, structure_functions
from mesoflow.operators.detect_stats import implied_ratio_verdict
from mesoflow.operators.quantiles import exact_medians
from mesoflow.operators.track_stats import nn_spacing
from mesoflow.plans.base import D_SQL, M_SQL, T_SQL, detections, tracks, with_run
from mesoflow.session import ensure_checkpoint_dir
from mesoflow.streaming.live import frame_observables


def _points(spark: SparkSession, d: str) -> DataFrame:
    return detections(spark, d).select("run_id", "frame", "det_id", "x", "y")


def _structure(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Points with coordination and order, and edges; both are read several times, so they are written once."""
    ensure_checkpoint_dir(spark)
    p = _points(spark, d)
    e = S.delaunay_edges(p, "det_id").checkpoint()
    return S.structure_points(p, e, "det_id").checkpoint(), e


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return S.delaunay_edges(_points(spark, d), "det_id")


def delaunay_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).withColumn("len", F.round("len", 6))


def coordination(spark: SparkSession, d: str) -> DataFrame:
    return _structure(spark, d)[0].groupBy("run_id", "coord").agg(F.count(F.lit(1)).alias("n"))


def psi6(spark: SparkSession, d: str) -> DataFrame:
    return _structure(spark, d)[0].select("det_id", "coord", F.round("psi_re", 6).alias("psi_re"), F.round("psi_im", 6).alias("psi_im"), F.round(F.hypot("psi_re", "psi_im"), 6).alias("psi_abs"))


def pairs57(spark: SparkSession, d: str) -> DataFrame:
    p, e = _structure(spark, d)
    return S.pairs57(p, e, "det_id", 96.0).withColumn("misorientation_deg", F.round("misorientation_deg", 5))


def defect_series(spark: SparkSession, d: str) -> DataFrame:
    t = S.defect_series(_structure(spark, d)[0])
    return t.select("run_id", "frame", "n", *[F.round(c, 6).alias(c) for c in ("frac_defect", "frac_5fold", "frac_7fold", "mean_psi6")])


def pair_count_series(spark: SparkSession, d: str) -> DataFrame:
    """Dislocation pairs per frame and per square pixel, 0 where there are none."""
    p, e = _structure(spark, d)
    n = S.pairs57(p, e, "det_id", 96.0).groupBy("run_id", "frame").agg(F.count(F.lit(1)).alias("n_pairs"))
    a = p.groupBy("run_id", "frame").agg(((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("area"))
    j = a.join(n, ["run_id", "frame"], "left").fillna(0, ["n_pairs"])
    return j.withColumn("density", F.round(F.when(F.col("area") > 0, F.col("n_pairs") / F.col("area")), 9))


def g6_hist(spark: SparkSession, d: str) -> DataFrame:
    p = _structure(spark, d)[0]
    weight = F.col("a_re") * F.col("b_re") + F.col("a_im") * F.col("b_im")
    g = pair_counts(p, "det_id", 60.0, 2.0, weight=weight)
    norm = p.groupBy("run_id").agg(F.avg(F.col("psi_re") * F.col("psi_re") + F.col("psi_im") * F.col("psi_im")).alias("_m"))
    return g.join(norm, "run_id").select("run_id", "bin", "n", F.round(F.when(F.col("_m") > 0, F.col("w") / F.col("n") / F.col("_m")), 6).alias("g6"))


def grain_components(spark: SparkSession, d: str) -> DataFrame:
    p, e = _structure(spark, d)
    return S.grains(p, e, "det_id").groupBy("run_id", "frame", "grain").agg(F.count(F.lit(1)).alias("n_points"))


def dbscan_labels(spark: SparkSession, d: str) -> DataFrame:
    return S.dbscan(_points(spark, d), "det_id", 30.0, 4)


def _lines(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(points, edges, pairs, boundaries, members)."""
    p, e = _structure(spark, d)
    pairs = S.pairs57(p, e, "det_id", 96.0).checkpoint()
    b, m = S.boundaries(pairs, 76.0, 3, 2.0, 15.0)
    return p, e, pairs, b, m


def _rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    """Floats to ``digits``; 0 has no sign."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in cols})


def boundaries(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_lines(spark, d)[3], 4, "aspect", "misorientation_deg", "cx", "cy", "ux", "uy", "x1", "y1", "x2", "y2")


def band_misorientation(spark: SparkSession, d: str) -> DataFrame:
    p, _, _, b, m = _lines(spark, d)
    b = b.join(nn_spacing(_points(spark, d), "det_id").select("run_id", "spacing"), "run_id").checkpoint()
    return _rounded(S.band_misorientation(b, m, p, F.col("spacing")), 4, "theta_grains_deg")


def defect_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows of a defects file: dislocation pairs and boundaries of each frame by their middle, in px and um."""
    _, _, pairs, b, _ = _lines(spark, d)
    none = lambda kind: F.lit(None).cast(kind)
    one = pairs.select("run_id", "frame", F.lit("dislocation_57").alias("type"), F.col("x").alias("x_px"), F.col("y").alias("y_px"), none("bigint").alias("n_dislocations"), none("double").alias("aspect"), "misorientation_deg")
    two = b.select("run_id", "frame", F.col("kind").alias("type"), ((F.col("x1") + F.col("x2")) / 2).alias("x_px"), ((F.col("y1") + F.col("y2")) / 2).alias("y_px"), F.col("n").alias("n_dislocations"), "aspect", "misorientation_deg")
    t = with_run(one.unionByName(two), spark, d, "px_um").withColumn("x_um", F.col("x_px") * F.col("px_um")).withColumn("y_um", F.col("y_px") * F.col("px_um")).drop("px_um")
    return _rounded(t, 4, "x_px", "y_px", "x_um", "y_um", "aspect", "misorientation_deg")


def live_observables(spark: SparkSession, d: str) -> DataFrame:
    """What the live view records of each frame: seconds since the run's first, particles, dislocation pairs, defects, order, low-angle boundaries and area."""
    p, _, pairs, b, _ = _lines(spark, d)
    o = with_run(frame_observables(p, pairs, b), spark, d, "dt", "w", "h", "px_um")
    first = o.groupBy("run_id").agg(F.min("frame").alias("_f0"))
    o = o.join(first, "run_id").withColumn("t_s", (F.col("frame") - F.col("_f0")) * F.col("dt")).withColumn("area_um2", F.col("w") * F.col("h") * F.col("px_um") * F.col("px_um"))
    o = o.withColumn("pairs_per_um2", F.col("n_57_pairs") / F.greatest("area_um2", F.lit(1e-9)))
    return _rounded(o.select("run_id", "frame", "t_s", "n_particles", "n_57_pairs", "pairs_per_um2", "frac_defect", "mean_psi6", "n_lagb", "area_um2"), 6, "t_s", "pairs_per_um2", "frac_defect", "mean_psi6", "area_um2")


def _gofr(spark: SparkSession, d: str, p: DataFrame) -> DataFrame:
    ranges = with_run(p.select("run_id").distinct(), spark, d, "px_um", "params.diameter")
    rmax, dr = default_range(F.col("diameter") * F.col("px_um"))
    t = structure_functions(p, "det_id", ranges.select("run_id", "px_um", rmax.alias("rmax"), dr.alias("dr")))
    return _rounded(t, 6, "r_um", "g_r", "g6_r", "g6_over_g_r")


def gofr_table(spark: SparkSession, d: str) -> DataFrame:
    """Both pair correlations and their ratio over all frames, to ten diameters of each run's particles in bins of a tenth of one."""
    return _gofr(spark, d, _structure(spark, d)[0])


def gofr_first_frame(spark: SparkSession, d: str) -> DataFrame:
    """The same of each run's first frame alone."""
    p = _structure(spark, d)[0]
    return _gofr(spark, d, p.join(p.groupBy("run_id").agg(F.min("frame").alias("frame")), ["run_id", "frame"], "left_semi"))


def per_particle(spark: SparkSession, d: str) -> DataFrame:
    """``x, y, up_fraction, flip_rate, Nf`` of each track: mean place, share of frames and rate of changes of its spin, and mean number of neighbours of its own spin over its frames."""
    ensure_checkpoint_dir(spark)
    t = tracks(spark, d).select("obs_id", "run_id", "particle", "frame", F.col("x_px").alias("x"), F.col("y_px").alias("y")).checkpoint()
    mean = t.groupBy("run_id", "particle").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    s = t.join(mean.select("run_id", "particle", F.round("y", 3).alias("_y")), ["run_id", "particle"]).select("obs_id", "run_id", "particle", "frame", F.when(F.col("y") >= F.col("_y"), 1).otherwise(-1).alias("s")).checkpoint()
    bonds = S.frustrated_bonds(S.delaunay_edges(t, "obs_id"), s, "obs_id").select("obs_id", "n_frustrated")
    nf = s.join(bonds, "obs_id", "left").groupBy("run_id", "particle").agg(F.avg(F.coalesce("n_frustrated", F.lit(0))).alias("Nf"))
    own = R.spin_stats(with_run(s, spark, d, "dt"), ["run_id", "particle"], "frame", F.col("dt"))
    return _rounded(mean.join(own, ["run_id", "particle"]).join(nf, ["run_id", "particle"]).select("run_id", "particle", "x", "y", "up_fraction", "flip_rate", "Nf"), 6, "x", "y", "up_fraction", "flip_rate", "Nf")


def _identities(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points, members of tracked boundaries, scale): trimmed, with merge gap and offsets from the run's own core spacing D0 (100 px if there is none)."""
    ensure_checkpoint_dir(spark)
    p, _, _, b, m = _lines(spark, d)
    scale = with_run(nn_spacing(_points(spark, d), "det_id").select("run_id", "spacing"), spark, d, "px_um").checkpoint()
    keys = ["run_id", "frame", "gb"]
    far = F.coalesce(2 * F.col("spacing"), F.lit(float("inf")))
    m = S.trim_members(m.join(scale.select("run_id", "spacing"), "run_id", "left"), far).drop("s")
    m = m.join(b.select(*keys, (F.col("kind") == "LAGB").alias("low")), keys).drop("h").checkpoint()
    placed = S.along_line(m, S.line_fit(m, keys), keys)
    cores = R.collapse_cores(placed.withColumn("_core", F.coalesce(2 * F.col("spacing"), F.lit(-1.0))), keys, "s", "h", F.col("_core"))
    gaps = cores.select("run_id", (F.col("s") - F.lag("s").over(Window.partitionBy(*keys).orderBy("s"))).alias("_d")).where("_d is not null")
    d0 = exact_medians(gaps, ["run_id"], "_d").select("run_id", F.col("median").alias("_d0"))
    s = scale.join(d0, "run_id", "left").withColumn("_d0", F.coalesce("_d0", F.lit(100.0)))
    settings = s.select("run_id", (3 * F.col("_d0")).alias("merge_gap"), F.greatest(F.lit(60.0), 2.5 * F.col("spacing"), 0.2 * F.col("_d0")).alias("max_off")).checkpoint()
    return p, track_boundaries(m.drop("spacing"), settings).checkpoint(), scale


def boundary_tracks(spark: SparkSession, d: str) -> DataFrame:
    t = _identities(spark, d)[1]
    return t.groupBy("run_id", "gb_id").agg(F.count_distinct("frame").alias("n_frames"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count(F.lit(1)).alias("n_members"))


def _lagb(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    """(points, members, axes, cores, summary, scale) of the boundaries that last a fifth of the run's frames, ten at least, and are low-angle in half of theirs."""
    p, t, scale = _identities(spark, d)
    nf = _points(spark, d).groupBy("run_id").agg(F.count_distinct("frame").alias("_nf"))
    t = B.lasting(t.join(nf, "run_id"), F.greatest(F.lit(10), F.floor(F.col("_nf") / 5))).drop("_nf").checkpoint()
    axes = B.pooled_axes(t).checkpoint()
    cores = B.pooled_cores(t, axes, scale).checkpoint()
    return p, t, axes, cores, B.boundary_summary(cores, t, scale).checkpoint(), scale


def lagb_statistics(spark: SparkSession, d: str) -> DataFrame:
    p, t, axes, cores, s, scale = _lagb(spark, d)
    eta = B.peak_exponents(B.structure_factor(cores, s), s).groupBy("run_id", "gb_id").agg(*[F.max(F.when(F.col("m") == k, F.col("eta"))).alias(f"eta_{k}") for k in (1, 2, 3)])
    theta = B.pooled_misorientation(t, axes, s, p, scale)
    return s.join(theta, ["run_id", "gb_id"], "left").join(eta, ["run_id", "gb_id"], "left")


def lagb_fluctuations(spark: SparkSession, d: str) -> DataFrame:
    *_, cores, s, _ = _lagb(spark, d)
    return B.fluctuations(cores, s)


def lagb_structure_factor(spark: SparkSession, d: str) -> DataFrame:
    *_, cores, s, _ = _lagb(spark, d)
    return B.structure_factor(cores, s)


def lagb_spacings(spark: SparkSession, d: str) -> DataFrame:
    *_, cores, s, _ = _lagb(spark, d)
    return B.normed_spacings(cores, s)


def overlay_points(spark: SparkSession, d: str) -> DataFrame:
    """What an overlay would draw for the points, as rows: place, radius (half the run's diameter) and class by coordination."""
    p = with_run(_structure(spark, d)[0], spark, d, "params.diameter")
    kind = F.when(F.col("coord") == 5, "five").when(F.col("coord") == 7, "seven").when(F.col("coord") == 6, "six").otherwise("other")
    color = F.when(F.col("coord") == 5, "red").when(F.col("coord") == 7, "blue").when(F.col("coord") == 6, "green").otherwise("grey")
    return p.select("run_id", "frame", "det_id", "x", "y", (F.col("diameter") / 2).alias("r"), kind.alias("class"), color.alias("color"))


def overlay_segments(spark: SparkSession, d: str) -> DataFrame:
    """What an overlay would draw, as rows: bonds, dislocation pairs and boundary lines of each frame."""
    p, e, pairs, b, _ = _lines(spark, d)
    at = lambda c, k: p.select(F.col("det_id").alias(c), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    seg = ["run_id", "frame", "x1", "y1", "x2", "y2"]
    bonds = e.join(at("i", 1), "i").join(at("j", 2), "j").select(*seg, F.lit("bond").alias("kind"))
    ends = pairs.select("run_id", "frame", "i5", "i7").join(at("i5", 1), "i5").join(at("i7", 2), "i7").select(*seg, F.lit("pair57").alias("kind"))
    return _rounded(bonds.unionByName(ends).unionByName(b.select(*seg, "kind")), 4, "x1", "y1", "x2", "y2")


def boundary_labels(spark: SparkSession, d: str) -> DataFrame:
    """The five longest boundaries of each frame (a top-k report)."""
    b = _lines(spark, d)[3].withColumn("length", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    k = F.row_number().over(Window.partitionBy("run_id", "frame").orderBy(F.col("length").desc(), "gb"))
    return _rounded(b.withColumn("label", k).where("label <= 5").select("run_id", "frame", "gb", "label", "kind", "length", "misorientation_deg"), 4, "length", "misorientation_deg")


def _spins(spark: SparkSession, d: str) -> DataFrame:
    """Bright or faint against the run's median mass."""
    t = detections(spark, d)
    med = exact_medians(t, ["run_id"], "mass").select("run_id", "median")
    return t.join(med, "run_id").select("det_id", F.when(F.col("mass") > F.col("median"), 1).otherwise(-1).alias("s"))


def bond_length_filter(spark: SparkSession, d: str) -> DataFrame:
    return S.bond_filter(_edges(spark, d)).withColumn("len", F.round("len", 6))


def bond_asymmetry(spark: SparkSession, d: str) -> DataFrame:
    """Mean bond lengths between equal and opposite spins, by how much the mixed ones are shorter, and what that says."""
    ensure_checkpoint_dir(spark)
    b = S.bond_asymmetry(S.bond_filter(_edges(spark, d).checkpoint()), _spins(spark, d), "det_id")
    height, verdict = implied_ratio_verdict(F.round(F.col("len_mixed") / F.col("len_same"), 9))
    b = b.withColumn("implied_hd", height).withColumn("verdict", F.when(F.col("len_mixed").isNotNull() & F.col("len_same").isNotNull(), verdict))
    return b.select("run_id", "n_same", "n_mixed", *[F.round(c, 5).alias(c) for c in ("len_same", "len_mixed", "percent")], F.round("implied_hd", 4).alias("implied_hd"), "verdict")


def frustrated_bonds(spark: SparkSession, d: str) -> DataFrame:
    return S.frustrated_bonds(_edges(spark, d), _spins(spark, d), "det_id")


def link_nn(spark: SparkSession, d: str) -> DataFrame:
    p = with_run(_points(spark, d), spark, d, "px_um", "params.max_step_um").withColumn("reach", F.coalesce(F.col("max_step_um") / F.col("px_um"), F.lit(27.3)))
    return L.link_nearest(p, "det_id")


def affine_full(spark: SparkSession, d: str) -> DataFrame:
    return L.correct_drift(with_run(tracks(spark, d), spark, d, "dt"), least=8)


def nms_separation(spark: SparkSession, d: str) -> DataFrame:
    return L.suppress_close(detections(spark, d), "det_id", 12.0)


def dedupe_points(spark: SparkSession, d: str) -> DataFrame:
    return L.dedupe_in_order(_points(spark, d), "det_id", 8.0)


_NAMES = """delaunay_edges coordination psi6 pairs57 defect_series pair_count_series g6_hist grain_components dbscan_labels boundaries band_misorientation defect_rows live_observables gofr_table gofr_first_frame per_particle
boundary_tracks lagb_statistics lagb_fluctuations lagb_structure_factor lagb_spacings bond_length_filter bond_asymmetry frustrated_bonds overlay_segments overlay_points boundary_labels link_nn affine_full nms_separation dedupe_points""".split()
QUERIES = {n: globals()[n] for n in _NAMES}

# the triangulation by its definition: a triangle counts if no other point lies in its circle; of points at one place the first counts
_TRIANGLES = """
p as (select run_id, frame, det_id as i, x, y from (select *, count(*) over (partition by run_id, frame) as c, row_number() over (partition by run_id, frame, x, y order by det_id) as u from d) where c >= 4 and u = 1),
t as (select a.run_id, a.frame, a.i as i, b.i as j, c.i as k, a.x as ax, a.y as ay, b.x as bx, b.y as b_y, c.x as cx, c.y as cy, (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) as turn
  from p a join p b on a.run_id = b.run_id and a.frame = b.frame and a.i < b.i join p c on c.run_id = a.run_id and c.frame = a.frame and b.i < c.i),
g as (select * from t where turn <> 0 and not exists (select 1 from p q where q.run_id = t.run_id and q.frame = t.frame and q.i <> t.i and q.i <> t.j and q.i <> t.k and
  (((ax - q.x) * (ax - q.x) + (ay - q.y) * (ay - q.y)) * ((bx - q.x) * (cy - q.y) - (cx - q.x) * (b_y - q.y))
  - ((bx - q.x) * (bx - q.x) + (b_y - q.y) * (b_y - q.y)) * ((ax - q.x) * (cy - q.y) - (cx - q.x) * (ay - q.y))
  + ((cx - q.x) * (cx - q.x) + (cy - q.y) * (cy - q.y)) * ((ax - q.x) * (b_y - q.y) - (bx - q.x) * (ay - q.y))) * sign(turn) > 0)),
e as (select run_id, frame, i, j from g union select run_id, frame, j, k from g union select run_id, frame, i, k from g),
l as (select e.*, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as len, a.x as ix, a.y as iy, b.x as jx, b.y as jy from e join d a on a.det_id = e.i join d b on b.det_id = e.j)"""
_EDGES = f"{D_SQL}, {_TRIANGLES}"
_ORDER = f"""{_EDGES},
w as (select i, jx - ix as dx, jy - iy as dy from l union all select j, ix - jx, iy - jy from l),
o as (select i, cast(count(*) as int) as coord, avg(cos(6 * atan2(dy, dx))) as re, avg(sin(6 * atan2(dy, dx))) as im from w group by 1),
s as (select d.run_id, d.frame, d.det_id, coalesce(coord, 0) as coord, coalesce(re, 0.0) as re, coalesce(im, 0.0) as im from d left join o on o.i = d.det_id)"""
# dislocation pairs, their density clusters by recursion, and the lines through these
_PAIRS = f"""{_ORDER},
v as (select l.*, case when a.coord = 5 then l.i else l.j end as i5, case when a.coord = 5 then l.j else l.i end as i7, (ix + jx) / 2 as x, (iy + jy) / 2 as y,
  case when sqrt(a.re * a.re + a.im * a.im) >= 0.1 and sqrt(b.re * b.re + b.im * b.im) >= 0.1 then degrees(abs(atan2(a.im * b.re - a.re * b.im, a.re * b.re + a.im * b.im))) / 6 end as mis
  from l join s a on a.det_id = l.i join s b on b.det_id = l.j where len <= 96 and ((a.coord = 5 and b.coord = 7) or (a.coord = 7 and b.coord = 5)))"""
_LINES = f"""{_PAIRS},
q as (select *, row_number() over (partition by run_id, frame order by i5, i7) as k from v),
nb as (select a.run_id, a.frame, a.k as i, b.k as j from q a join q b on a.run_id = b.run_id and a.frame = b.frame and a.k <> b.k where (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 76 * 76),
co as (select run_id, frame, i from nb group by 1, 2, 3 having count(*) + 1 >= 3),
ln as (select nb.* from nb join co c on c.run_id = nb.run_id and c.frame = nb.frame and c.i = nb.i join co e2 on e2.run_id = nb.run_id and e2.frame = nb.frame and e2.i = nb.j),
wk as (select run_id, frame, i, i as root from co union select ln.run_id, ln.frame, ln.j, wk.root from wk join ln on ln.run_id = wk.run_id and ln.frame = wk.frame and ln.i = wk.i where wk.root < ln.j),
kk as (select run_id, frame, i, min(root) as gb from wk group by 1, 2, 3),
bo as (select nb.run_id, nb.frame, nb.i, min(gb) as gb from nb join kk on kk.run_id = nb.run_id and kk.frame = nb.frame and kk.i = nb.j anti join co on co.run_id = nb.run_id and co.frame = nb.frame and co.i = nb.i group by 1, 2, 3),
me as (select q.run_id, q.frame, gb, q.x, q.y, mis from q join (select * from kk union all select * from bo) u on u.run_id = q.run_id and u.frame = q.frame and u.i = q.k),
f1 as (select run_id, frame, gb, count(*) as n, avg(x) as cx, avg(y) as cy, var_pop(x) as vx, var_pop(y) as vy, covar_pop(x, y) as vxy, coalesce(avg(mis), 0) as mis from me group by 1, 2, 3),
f2 as (select *, atan2(2 * vxy, vx - vy) / 2 as th, ((vx + vy) / 2 - sqrt(pow((vx - vy) / 2, 2) + vxy * vxy)) * n as low, ((vx + vy) / 2 + sqrt(pow((vx - vy) / 2, 2) + vxy * vxy)) * n as high from f1),
f3 as (select *, case when low > 1e-9 then sqrt(high / low) else 999.0 end as aspect, cos(th) as ux, sin(th) as uy from f2),
f4 as (select f3.run_id, f3.frame, f3.gb, any_value(n) as n, any_value(aspect) as aspect, any_value(f3.mis) as mis, any_value(cx) as cx, any_value(cy) as cy, any_value(ux) as ux, any_value(uy) as uy,
  min((x - cx) * ux + (y - cy) * uy) as s0, max((x - cx) * ux + (y - cy) * uy) as s1 from f3 join me on me.run_id = f3.run_id and me.frame = f3.frame and me.gb = f3.gb where aspect >= 2 and n >= 3 group by 1, 2, 3),
bd as (select run_id, frame, gb, case when mis < 15 then 'LAGB' else 'HAGB' end as kind, n, aspect, mis, cx, cy, ux, uy, cx + s0 * ux as x1, cy + s0 * uy as y1, cx + s1 * ux as x2, cy + s1 * uy as y2 from f4)"""
# the tracks under a name that the triangles leave free
_TRACKS = "tr" + T_SQL[1:]
_P = "cast(3.141592653589793 as double)"

_GOFR = f"""with {_ORDER}, z as (select s.*, d.x, d.y from s join d on d.det_id = s.det_id),
g0 as (select run_id, cast(json_extract_string(params, '$.px_um') as double) as px, cast(json_extract_string(params, '$.diameter') as double) * cast(json_extract_string(params, '$.px_um') as double) as dm from job_meta),
g1 as (select run_id, px, least(greatest(10 * dm, 0.5), 100.0) as rmax, least(greatest(dm / 10, 0.01), 5.0) as dr from g0 where px > 0 and dm is not null),
g2 as (select *, cast(greatest(1, floor(rmax / dr)) as int) as bins, rmax / cast(greatest(1, floor(rmax / dr)) as int) as wd from g1),
f as (select z.run_id, frame, count(*) as n, (max(x) - min(x)) * (max(y) - min(y)) * any_value(px) * any_value(px) as a, sum(re * re + im * im) as p from z join g2 on g2.run_id = z.run_id group by 1, 2),
u as (select run_id, count(*) as fr, avg(n) as nn, avg(case when n > 1 then a else 0.0 end) as aa, sum(p) / sum(n) as mp from f group by 1),
p2 as (select a.run_id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) * px as dist, a.re * b.re + a.im * b.im as w, rmax, wd, bins from z a join z b on a.run_id = b.run_id and a.frame = b.frame and a.det_id < b.det_id join g2 on g2.run_id = a.run_id),
h as (select run_id, cast(least(floor(dist / wd), bins - 1) as int) as bin, count(*) as n, sum(w) as w from p2 where dist < rmax group by 1, 2),
e4 as (select u.*, wd, bins, cast(unnest(range(bins)) as int) as bin from u join g2 on g2.run_id = u.run_id),
r as (select e4.run_id, e4.bin, (e4.bin + 0.5) * wd as r_um, coalesce(h.n, 0) as n_pairs, case when aa > 0 then 2 * coalesce(h.n, 0) / (fr * nn * (nn / aa) * (2 * {_P} * wd) * ((e4.bin + 0.5) * wd)) end as g_r,
  case when h.n > 0 then h.w / h.n / greatest(mp, 1e-12) end as g6_r from e4 left join h on h.run_id = e4.run_id and h.bin = e4.bin)
select run_id, bin, round(r_um, 6) as r_um, n_pairs, round(g_r, 6) + 0.0 as g_r, round(g6_r, 6) + 0.0 as g6_r, round(case when g_r > 0 then g6_r / g_r end, 6) + 0.0 as g6_over_g_r from r"""

SQL = {
    "boundaries": f"""with recursive {_LINES} select run_id, frame, gb, kind, n, round(aspect, 4) as aspect, round(mis, 4) + 0.0 as misorientation_deg, round(cx, 4) + 0.0 as cx, round(cy, 4) + 0.0 as cy,
  round(ux, 4) + 0.0 as ux, round(uy, 4) + 0.0 as uy, round(x1, 4) + 0.0 as x1, round(y1, 4) + 0.0 as y1, round(x2, 4) + 0.0 as x2, round(y2, 4) + 0.0 as y2 from bd""",
    "band_misorientation": f"""with recursive {_LINES}, nk as (select a.run_id, a.frame, a.det_id as i, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) as dist from d a join d b on a.run_id = b.run_id and a.frame = b.frame and a.det_id <> b.det_id group by 1, 2, 3),
ff as (select run_id, frame, count(*) as n from d group by 1, 2), fo as (select *, row_number() over (partition by run_id order by frame) - 1 as pos, greatest(1, floor(count(*) over (partition by run_id) / 12)) as step from ff),
fu as (select run_id, frame from fo where pos % step = 0 and floor(pos / step) < 12 and n >= 8), sp as (select nk.run_id, median(dist) as b from nk join fu on fu.run_id = nk.run_id and fu.frame = nk.frame group by 1),
ms as (select me.run_id, me.frame, me.gb, (me.x - f4.cx) * f4.ux + (me.y - f4.cy) * f4.uy as sx from me join f4 on f4.run_id = me.run_id and f4.frame = me.frame and f4.gb = me.gb),
mg as (select run_id, frame, gb, sx - lag(sx) over (partition by run_id, frame, gb order by sx) as gap from ms), md as (select run_id, frame, gb, median(gap) as dd from mg where gap is not null group by 1, 2, 3),
wd as (select f4.*, b, 1.5 * b as inn, 1.5 * b + greatest(2 * b, greatest(coalesce(dd, b), b) / 2) as outt from f4 join sp on sp.run_id = f4.run_id left join md on md.run_id = f4.run_id and md.frame = f4.frame and md.gb = f4.gb),
pt as (select s.run_id, s.frame, d.x, d.y, re / sqrt(re * re + im * im) as ur, im / sqrt(re * re + im * im) as ui from s join d on d.det_id = s.det_id where sqrt(re * re + im * im) > 0.3),
bj as (select wd.run_id, wd.frame, wd.gb, (pt.x - cx) * ux + (pt.y - cy) * uy as ss, (pt.y - cy) * ux - (pt.x - cx) * uy as hh, ur, ui, s0, s1, inn, outt from wd join pt on pt.run_id = wd.run_id and pt.frame = wd.frame),
bs as (select run_id, frame, gb, hh > 0 as up, count(*) as n, atan2(avg(ui), avg(ur)) / 6 as ang from bj where ss > s0 and ss < s1 and abs(hh) > inn and abs(hh) < outt group by 1, 2, 3, 4 having count(*) >= 5)
select a.run_id, a.frame, a.gb, round(abs(degrees(a.ang - c.ang) + 30 - floor((degrees(a.ang - c.ang) + 30) / 60) * 60 - 30), 4) + 0.0 as theta_grains_deg, a.n as n_band_a, c.n as n_band_b
from bs a join bs c on a.run_id = c.run_id and a.frame = c.frame and a.gb = c.gb and a.up and not c.up""",
    "per_particle": f"""with {_TRACKS}, {M_SQL}, d as (select obs_id as det_id, run_id, frame, x_px as x, y_px as y from tr), {_TRIANGLES},
mn as (select run_id, particle, avg(x_px) as x, avg(y_px) as y from tr group by 1, 2),
sp as (select obs_id, tr.run_id, tr.particle, tr.frame, case when y_px >= round(mn.y, 3) then 1 else -1 end as s from tr join mn on mn.run_id = tr.run_id and mn.particle = tr.particle),
ee as (select e.i, e.j from e join sp a on a.obs_id = e.i join sp b on b.obs_id = e.j where a.s = b.s), eb as (select o, count(*) as c from (select i as o from ee union all select j from ee) group by 1),
nf as (select run_id, particle, avg(coalesce(c, 0)) as nf from sp left join eb on eb.o = sp.obs_id group by 1, 2),
fl as (select *, case when s <> lag(s) over (partition by run_id, particle order by frame) then 1 else 0 end as f from sp),
fg as (select run_id, particle, count(*) as n, avg(case when s > 0 then 1.0 else 0.0 end) as up, sum(f) as f from fl group by 1, 2)
select mn.run_id, mn.particle, round(mn.x, 6) + 0.0 as x, round(mn.y, 6) + 0.0 as y, round(up, 6) as up_fraction, case when n > 1 then round(f / (dt * (n - 1)), 6) end as flip_rate, round(nf, 6) as "Nf"
from mn join fg on fg.run_id = mn.run_id and fg.particle = mn.particle join nf on nf.run_id = mn.run_id and nf.particle = mn.particle left join m on m.run_id = mn.run_id""",
    "boundary_labels": f"""with recursive {_LINES}, r as (select *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) as length from bd),
z as (select *, row_number() over (partition by run_id, frame order by length desc, gb) as label from r)
select run_id, frame, gb, cast(label as int) as label, kind, round(length, 4) as length, round(mis, 4) + 0.0 as misorientation_deg from z where label <= 5""",
    "overlay_segments": f"""with recursive {_LINES}, r as (select run_id, frame, ix as x1, iy as y1, jx as x2, jy as y2, 'bond' as kind from l
  union all select v.run_id, v.frame, a.x, a.y, b.x, b.y, 'pair57' from v join d a on a.det_id = v.i5 join d b on b.det_id = v.i7
  union all select run_id, frame, x1, y1, x2, y2, kind from bd)
select run_id, frame, round(x1, 4) + 0.0 as x1, round(y1, 4) + 0.0 as y1, round(x2, 4) + 0.0 as x2, round(y2, 4) + 0.0 as y2, kind from r""",
    "overlay_points": f"""with {_ORDER} select s.run_id, s.frame, s.det_id, x, y, cast(json_extract_string(params, '$.diameter') as double) / 2 as r,
  case coord when 5 then 'five' when 7 then 'seven' when 6 then 'six' else 'other' end as class, case coord when 5 then 'red' when 7 then 'blue' when 6 then 'green' else 'grey' end as color
  from s join d on d.det_id = s.det_id left join job_meta j on j.run_id = s.run_id""",
    "defect_rows": f"""with recursive {_LINES}, r as (select run_id, frame, 'dislocation_57' as type, x as x_px, y as y_px, cast(null as bigint) as n_dislocations, cast(null as double) as aspect, mis from v
  union all select run_id, frame, kind, (x1 + x2) / 2, (y1 + y2) / 2, n, aspect, mis from bd)
select r.run_id, frame, type, round(x_px, 4) + 0.0 as x_px, round(y_px, 4) + 0.0 as y_px, round(x_px * px_um, 4) + 0.0 as x_um, round(y_px * px_um, 4) + 0.0 as y_um, n_dislocations, round(aspect, 4) as aspect,
  round(mis, 4) + 0.0 as misorientation_deg from r left join (select run_id, cast(json_extract_string(params, '$.px_um') as double) as px_um from job_meta) j on j.run_id = r.run_id""",
    "live_observables": f"""with recursive {_LINES}, {M_SQL}, o2 as (select run_id, frame, count(*) as n_particles, avg(case when coord <> 6 then 1.0 else 0.0 end) as frac_defect, avg(sqrt(re * re + im * im)) as mean_psi6 from s group by 1, 2),
n57 as (select run_id, frame, count(*) as n from v group by 1, 2), nl as (select run_id, frame, count(*) as n from bd where kind = 'LAGB' group by 1, 2)
select o2.run_id, o2.frame, round((o2.frame - min(o2.frame) over (partition by o2.run_id)) * dt, 6) as t_s, n_particles, coalesce(n57.n, 0) as n_57_pairs, round(coalesce(n57.n, 0) / greatest(w * h * px_um * px_um, 1e-9), 6) as pairs_per_um2,
  round(frac_defect, 6) as frac_defect, round(mean_psi6, 6) as mean_psi6, coalesce(nl.n, 0) as n_lagb, round(cast(w as double) * h * px_um * px_um, 6) as area_um2
from o2 left join n57 on n57.run_id = o2.run_id and n57.frame = o2.frame left join nl on nl.run_id = o2.run_id and nl.frame = o2.frame left join m on m.run_id = o2.run_id""",
    "gofr_table": _GOFR,
    "gofr_first_frame": _GOFR.replace("on d.det_id = s.det_id),", "on d.det_id = s.det_id join (select run_id, min(frame) as f0 from d group by 1) a0 on a0.run_id = s.run_id and a0.f0 = s.frame),", 1),
    "dbscan_labels": f"""with recursive {D_SQL}, p as (select a.run_id, a.frame, a.det_id as i, b.det_id as j from d a join d b on a.run_id = b.run_id and a.frame = b.frame and a.det_id <> b.det_id
  where (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 900),
c as (select i from p group by 1 having count(*) + 1 >= 4),
q as (select i, j from p where i in (select i from c) and j in (select i from c)),
w as (select i, i as root from c union select q.j, w.root from w join q on q.i = w.i where w.root < q.j),
k as (select i, min(root) as component from w group by 1),
o as (select p.i, min(component) as component from p join k on k.i = p.j where p.i not in (select i from c) group by 1),
u as (select * from k union all select * from o)
select d.run_id, d.frame, d.det_id, coalesce(component, -1) as cluster from d left join u on u.i = d.det_id""",
    "delaunay_edges": f"with {_EDGES} select run_id, frame, i, j, round(len, 6) as len from l",
    "coordination": f"with {_ORDER} select run_id, coord, count(*) as n from s group by 1, 2",
    "psi6": f"with {_ORDER} select det_id, coord, round(re, 6) + 0.0 as psi_re, round(im, 6) + 0.0 as psi_im, round(sqrt(re * re + im * im), 6) as psi_abs from s",
    "defect_series": f"""with {_ORDER} select run_id, frame, count(*) as n, round(avg(case when coord <> 6 then 1.0 else 0.0 end), 6) as frac_defect, round(avg(case when coord = 5 then 1.0 else 0.0 end), 6) as frac_5fold,
  round(avg(case when coord = 7 then 1.0 else 0.0 end), 6) as frac_7fold, round(avg(sqrt(re * re + im * im)), 6) as mean_psi6 from s group by 1, 2""",
    "pairs57": f"""with {_ORDER}, v as (select l.*, a.coord as ci, a.re as ar, a.im as ai, b.coord as cj, b.re as br, b.im as bi from l join s a on a.det_id = l.i join s b on b.det_id = l.j
  where len <= 96 and ((a.coord = 5 and b.coord = 7) or (a.coord = 7 and b.coord = 5)))
select run_id, frame, case when ci = 5 then i else j end as i5, case when ci = 5 then j else i end as i7, (ix + jx) / 2 as x, (iy + jy) / 2 as y,
  case when sqrt(ar * ar + ai * ai) >= 0.1 and sqrt(br * br + bi * bi) >= 0.1 then round(degrees(abs(atan2(ai * br - ar * bi, ar * br + ai * bi))) / 6, 5) end as misorientation_deg from v""",
    "pair_count_series": f"""with {_ORDER}, v as (select l.run_id, l.frame, count(*) as n from l join s a on a.det_id = l.i join s b on b.det_id = l.j
  where len <= 96 and ((a.coord = 5 and b.coord = 7) or (a.coord = 7 and b.coord = 5)) group by 1, 2),
f as (select run_id, frame, (max(x) - min(x)) * (max(y) - min(y)) as area from d group by 1, 2)
select f.run_id, f.frame, area, coalesce(n, 0) as n_pairs, case when area > 0 then round(coalesce(n, 0) / area, 9) end as density from f left join v on v.run_id = f.run_id and v.frame = f.frame""",
    "g6_hist": f"""with {_ORDER}, z as (select s.*, d.x, d.y from s join d on d.det_id = s.det_id), m as (select run_id, avg(re * re + im * im) as m from s group by 1),
h as (select a.run_id, cast(least(floor(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / 2.0), 29) as int) as bin, count(*) as n, sum(a.re * b.re + a.im * b.im) as w from z a join z b
  on a.run_id = b.run_id and a.frame = b.frame and a.det_id < b.det_id where (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 3600 group by 1, 2)
select h.run_id, bin, n, case when m > 0 then round(w / n / m, 6) + 0.0 end as g6 from h join m on m.run_id = h.run_id""",
    "bond_length_filter": f"with {_EDGES}, b as (select *, median(len) over (partition by run_id, frame) as med from l) select run_id, frame, i, j, round(len, 6) as len from b where len < 1.4 * med",
    "bond_asymmetry": f"""with {_EDGES}, b as (select *, median(len) over (partition by run_id, frame) as med from l), k as (select * from b where len < 1.4 * med),
n as (select det_id, mass > median(mass) over (partition by run_id) as up from d),
q2 as (select k.run_id, a.up = c.up as same, len from k join n a on a.det_id = k.i join n c on c.det_id = k.j)
select run_id, count(case when same then 1 end) as n_same, count(case when not same then 1 end) as n_mixed, round(avg(case when same then len end), 5) as len_same,
  round(avg(case when not same then len end), 5) as len_mixed, round((1 - avg(case when not same then len end) / avg(case when same then len end)) * 100, 5) as percent,
  case when avg(case when not same then len end) / avg(case when same then len end) < 1 then round(1 + sqrt(1 - pow(round(avg(case when not same then len end) / avg(case when same then len end), 9), 2)), 4) end as implied_hd,
  case when avg(case when not same then len end) / avg(case when same then len end) <= 0.75 then 'second layer' when avg(case when not same then len end) / avg(case when same then len end) <= 0.985 then 'buckling'
    when avg(case when not same then len end) / avg(case when same then len end) is not null then 'no asymmetry' end as verdict from q2 group by 1""",
    "frustrated_bonds": f"""with {_EDGES}, n as (select det_id, mass > median(mass) over (partition by run_id) as up from d),
q2 as (select l.run_id, l.frame, l.i, l.j from l join n a on a.det_id = l.i join n c on c.det_id = l.j where a.up = c.up)
select run_id, frame, det_id, count(*) as n_frustrated from (select run_id, frame, i as det_id from q2 union all select run_id, frame, j from q2) group by 1, 2, 3""",
    "grain_components": f"""with recursive {_ORDER}, a as (select det_id as i, run_id, frame, atan2(im, re) / 6 as th from s where sqrt(re * re + im * im) > 0.6),
x as (select l.i, l.j, a.th - b.th + pi() / 6 as z from l join a on a.i = l.i join a b on b.i = l.j),
k as (select i, j from x where abs(z - floor(z / (pi() / 3)) * (pi() / 3) - pi() / 6) <= pi() / 12 / 6),
y as (select i, j from k union all select j, i from k),
c as (select i, i as root from a union select y.j, c.root from c join y on y.i = c.i where c.root < y.j),
r as (select i, min(root) as grain from c group by 1)
select run_id, frame, grain, count(*) as n_points from r join a on a.i = r.i group by 1, 2, 3""",
}
