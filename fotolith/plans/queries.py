"""One query for each operator over the driver's tables, with the DuckDB SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fotolith.functions import media, paths
from fotolith.operators import grid, indexing, ranks, resolve, scoring, sessions, tables, vectors
from fotolith.plans.catalog import score_library
from fotolith.plans.checkpoint import cutter
from fotolith.plans.datasets import ctes, frame
from fotolith.sources.files import sidecar_plan
from fotolith.streaming import settle

GAP = 43200
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, uses: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            body = sql.lstrip()
            more, body = body.startswith("+"), body.lstrip("+").lstrip()
            recursive, body = body.startswith("recursive "), body.removeprefix("recursive ")
            ORACLES[f.__name__] = f"with {'recursive ' if recursive else ''}{ctes(*uses)}{', ' if more else ' '}{body}" if uses else sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# sessions and ranks -----------------------------------------------------------------------------------------------

_SHOOTS = f"""+ a as (select *, lag(captured_at) over (partition by dir, camera order by captured_at nulls last, photo_id) as p from t_frames),
b as (select *, case when captured_at is not null then sum(case when captured_at is not null and (p is null or captured_at - p > {GAP}) then 1 else 0 end) over (partition by dir, camera order by captured_at nulls last, photo_id rows unbounded preceding) end as k from a),
c as (select *, dense_rank() over (order by dir, camera nulls first, (captured_at is null)::int, k) - 1 as shoot_id from b),
s as (select *, count(*) over (partition by shoot_id) as shoot_size from c)"""


@query(_SHOOTS + " select photo_id, shoot_id, shoot_size, captured_at is not null as time_clustered from s", ("frames",))
def shoots_sessionise(spark, d):
    return sessions.shoots(frame(spark, d, "frames"), GAP).select("photo_id", "shoot_id", "shoot_size", "time_clustered")


@query("""select l_orderkey, l_linenumber, case when count(*) over (partition by l_suppkey) = 1 then 50.0 else
  (rank() over (partition by l_suppkey order by l_quantity) - 1 + count(*) over (partition by l_suppkey, l_quantity) / 2.0) / count(*) over (partition by l_suppkey) * 100 end as r from lineitem""")
def midrank_in_group(spark, d):
    return _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ranks.mid_rank(["l_suppkey"], "l_quantity").alias("r"), "l_suppkey", "l_quantity").select("l_orderkey", "l_linenumber", "r")


@query("""select l_orderkey, l_linenumber, (rank() over (partition by l_returnflag order by l_extendedprice) - 1 + count(*) over (partition by l_returnflag, l_extendedprice) / 2.0)
  / count(*) over (partition by l_returnflag) * 100 as r from lineitem""")
def midrank_in_library(spark, d):
    return ranks.library_mid_rank(_read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice", "r").select("l_orderkey", "l_linenumber", "r")


def _rank_sql(part: str, m: str) -> str:
    over = f"partition by {part}" if part else ""
    comma = f"{part}, " if part else ""
    return f"case when count(*) over ({over}) = 1 then 50.0 else (rank() over ({over} order by {m}) - 1 + count(*) over (partition by {comma}{m}) / 2.0) / count(*) over ({over}) * 100 end"


_SCORED = _SHOOTS + f""",
r as (select *, {", ".join(f"{_rank_sql('shoot_id', f'm{i}')} as s{i}, {_rank_sql('', f'm{i}')} as l{i}" for i in (0, 1, 4, 5, 6, 7))} from s),
e as (select *, {", ".join(f"{'' if i in (0, 1, 4) else '100 - '}(case when shoot_size >= 8 then s{i} else l{i} end) as e{i}" for i in (0, 1, 4, 5, 6, 7))} from r),
w as (select *, e0 as p_focus, e1 as p_detail, e4 as p_range, least(e5, e6) as p_clip, e7 as p_noise from e)"""


def _composite(weights: tuple[int, ...]) -> str:
    return " + ".join(f"{w / 100!r} * {p}" for w, p in zip(weights, ("p_focus", "p_detail", "p_range", "p_clip", "p_noise"), strict=True))


_BANDED = _SCORED + f""", k as (select *, {_composite(scoring.PRESETS["Balanced"])} as composite from w),
banded as (select *, case when composite >= 70 then 'keep' when composite < 35 then 'reject' else 'review' end as band from k)"""


@query(_BANDED + " select photo_id, round(composite, 6) as composite, band from banded", ("frames",))
def composite_band(spark, d):
    return score_library(frame(spark, d, "frames"), gap=GAP).select("photo_id", F.round("composite", 6).alias("composite"), "band")


@query(_BANDED + " select band, count(*) as n, round(min(composite), 6) as lo, round(max(composite), 6) as hi from banded group by band", ("frames",))
def band_counts(spark, d):
    return score_library(frame(spark, d, "frames"), gap=GAP).groupBy("band").agg(F.count("*").alias("n"), F.round(F.min("composite"), 6).alias("lo"), F.round(F.max("composite"), 6).alias("hi"))


_PRESETS = ", ".join(f"('{n}', {', '.join(map(str, w))})" for n, w in scoring.PRESETS.items())


@query(_SCORED + f""", p(preset, a, b, c, d, e) as (values {_PRESETS}),
k as (select preset, a::double / 100 * p_focus + b::double / 100 * p_detail + c::double / 100 * p_range + d::double / 100 * p_clip + e::double / 100 * p_noise as composite from w, p)
select preset, count(*) as n, round(avg(composite), 6) as mean, count(*) filter (composite >= 70) as keep, count(*) filter (composite < 35) as reject from k group by preset""", ("frames",))
def preset_compare(spark, d):
    base = scoring.normalise(frame(spark, d, "frames"), GAP, scoring.SCORED, library_for_all=False)
    rows = base.select(F.explode(F.array(*(F.struct(F.lit(n).alias("preset"), F.aggregate(scoring.terms(w), F.lit(0.0), lambda s, t: s + t["contribution"]).alias("composite")) for n, w in scoring.PRESETS.items()))).alias("x")).select("x.*")
    return rows.groupBy("preset").agg(F.count("*").alias("n"), F.round(F.avg("composite"), 6).alias("mean"), F.count_if(F.col("composite") >= 70).alias("keep"), F.count_if(F.col("composite") < 35).alias("reject"))


_TERMS = _SCORED + """, t as (select photo_id, unnest([
 {'i': 1, 'label': 'focus', 'p': p_focus, 'raw': m0, 'w': 0.3::double}, {'i': 2, 'label': 'detail', 'p': p_detail, 'raw': m1, 'w': 0.2::double}, {'i': 3, 'label': 'tonal range', 'p': p_range, 'raw': m4, 'w': 0.15::double},
 {'i': 4, 'label': 'clipping', 'p': p_clip, 'raw': greatest(m5, m6), 'w': 0.2::double}, {'i': 5, 'label': 'noise', 'p': p_noise, 'raw': m7, 'w': 0.15::double}]) as x from w),
u as (select photo_id, x.i as i, x.label as label, x.p as p, x.raw as raw, x.w * x.p as gain, x.w * (100 - x.p) as loss from t),
up as (select photo_id, label, row_number() over (partition by photo_id order by gain desc, i) as k from u where p > 50),
dn as (select photo_id, label, row_number() over (partition by photo_id order by loss desc, i) as k from u where p < 50 and not (label = 'clipping' and raw <= 0.001) and not (label = 'noise' and raw <= 0))"""


@query(_TERMS + """ select f.photo_id, coalesce(a.l, '') as ups, coalesce(b.l, '') as downs from t_frames f
 left join (select photo_id, string_agg(label, ',' order by k) as l from up where k <= 2 group by 1) a using (photo_id)
 left join (select photo_id, string_agg(label, ',' order by k) as l from dn where k <= 2 group by 1) b using (photo_id)""", ("frames",))
def score_terms_top(spark, d):
    rows = score_library(frame(spark, d, "frames"), gap=GAP)
    return rows.select("photo_id", F.array_join(F.transform(scoring.contributors(F.col("terms")), lambda t: t["label"]), ",").alias("ups"), F.array_join(F.transform(scoring.detractors(F.col("terms")), lambda t: t["label"]), ",").alias("downs"))


@query()
def explain_scores(spark, d):
    return scoring.explain(score_library(frame(spark, d, "frames"), gap=GAP))


@query(_BANDED + """ select photo_id, metric, round(value, 6) as value from (select photo_id, unnest(['composite', 'band', 'shoot_size', 'shoot_relative', 'term:focus', 'term:detail', 'term:tonal_range', 'term:clipping', 'term:noise']) as metric,
 unnest([composite, case band when 'keep' then 2.0 when 'review' then 1.0 else 0.0 end, shoot_size::double, (shoot_size >= 8)::int::double, p_focus, p_detail, p_range, p_clip, p_noise]) as value from banded)""", ("frames",))
def score_rows(spark, d):
    return scoring.score_rows(score_library(frame(spark, d, "frames"), gap=GAP), "v1", 0).select("photo_id", "metric", F.round("value", 6).alias("value"))


@query(_BANDED + " select photo_id, round(p_focus, 6) as focus, round(p_noise, 6) as noise, round(p_detail, 6) as detail from banded", ("frames",))
def eav_pivot(spark, d):
    rows = scoring.score_rows(score_library(frame(spark, d, "frames"), gap=GAP), "v1", 0).withColumn("metric", F.regexp_replace("metric", "^term:", ""))
    return grid.pivot_quality(rows).select("photo_id", *(F.round(c, 6).alias(c) for c in ("focus", "noise", "detail")))


@query(_SHOOTS + " select shoot_id, median(m2) as anisotropy, median(m1) as detail, median(m0) as focus from s group by shoot_id", ("frames",))
def median_baseline(spark, d):
    return scoring.baselines(sessions.shoots(frame(spark, d, "frames"), GAP))


@query(_SHOOTS + ", b2 as (select shoot_id, median(m2) as a, median(m1) as e from s group by shoot_id) select photo_id, shoot_id from s join b2 using (shoot_id) where m2 > 2.5 * a and m1 < 0.6 * e", ("frames",))
def motion_candidates(spark, d):
    return scoring.motion_candidates(sessions.shoots(frame(spark, d, "frames"), GAP)).select("photo_id", "shoot_id")


_BURSTS = """+ a as (select *, lag(captured_at) over w as p, lag(hash) over w as h from t_shots where captured_at is not null window w as (partition by camera order by captured_at, photo_id)),
b as (select *, sum(case when p is null or captured_at - p > 20000 or coalesce(bit_count(xor(hash, h)) > 2, false) then 1 else 0 end) over (partition by camera order by captured_at, photo_id rows unbounded preceding) as k from a),
c as (select *, min(photo_id) over (partition by camera, k) as f, count(*) over (partition by camera, k) as burst_size from b),
g as (select *, dense_rank() over (order by f) - 1 as burst_id from c)"""


def _bursts(spark, d):
    return sessions.bursts(frame(spark, d, "shots"), gap=20000, distance=2)


@query(_BURSTS + " select photo_id, burst_id, burst_size from g", ("shots",))
def burst_group(spark, d):
    return _bursts(spark, d).select("photo_id", "burst_id", "burst_size")


_BRACKETS = _BURSTS + """, x as (select burst_id, exposure_time, iso, log2(exposure_time / lag(exposure_time) over (partition by burst_id order by exposure_time, photo_id)) as step from g where exposure_time > 0),
y as (select burst_id, count(*) as n, count(distinct iso) as isos, avg(step) as m, min(step) as lo, max(step) as hi, max(abs(step - round(step * 3) / 3)) as off from x group by burst_id),
br as (select g.burst_id, bool_or(coalesce(n >= 3 and isos <= 1 and lo > 0 and off <= 0.2 and hi - m <= 0.2 and m - lo <= 0.2 and m >= 1.0 / 3 - 0.2, false)) as is_bracket from g left join y using (burst_id) group by g.burst_id)"""


@query(_BRACKETS + " select burst_id, is_bracket from br", ("shots",))
def bracket_detect(spark, d):
    return sessions.brackets(_bursts(spark, d))


@query(_BRACKETS + """, z as (select g.photo_id, burst_id, is_bracket, case when g.photo_id % 4 != 0 then g.photo_id * 17 % 90 / 1e0 end as score, g.photo_id % 23 = 0 as manual from g join br using (burst_id)),
q as (select *, row_number() over (partition by burst_id order by manual desc, score desc nulls last, photo_id) as k from z)
select photo_id, burst_id, manual, is_bracket or manual or k <= 2 as keep from q""", ("shots",))
def keepers(spark, d):
    b = cutter(spark)(_bursts(spark, d))  # read three times
    ids = b.select("photo_id")
    scores = ids.where("photo_id % 4 != 0").selectExpr("photo_id", "photo_id * 17 % 90 / 1e0 as score")
    return sessions.keepers(b, scores, ids.where("photo_id % 23 = 0")).select("photo_id", "burst_id", "manual", "keep")


@query("""with v as (select l_returnflag, least(127, round(greatest(0.0, least(1.0, l_quantity / 50.0)) * 127))::int as bin from lineitem),
h as (select l_returnflag, bin, count(*) as n from v group by 1, 2),
c as (select *, sum(n) over (partition by l_returnflag order by bin) as acc, sum(n) over (partition by l_returnflag) as total from h)
select l_returnflag, """ + ", ".join(f"round(max(case when acc >= greatest(1, round(total * {p})) and acc - n < greatest(1, round(total * {p})) then least(1.0, (bin + (greatest(1, round(total * {p})) - (acc - n)) / n) / 127.0) end), 9) as p{i}" for i, p in enumerate((0.01, 0.5, 0.99))) + " from c group by 1")
def histogram_percentile(spark, d):
    rows = _read(spark, d, "lineitem").select("l_returnflag", (F.col("l_quantity") / 50.0).alias("v"))
    return tables.histogram_percentiles(rows, ["l_returnflag"], "v", 128, (0.01, 0.5, 0.99)).select("l_returnflag", *(F.round(f"p{i}", 9).alias(f"p{i}") for i in range(3)))


# resolving --------------------------------------------------------------------------------------------------------


def _names(spark, d):
    return _read(spark, d, "part").selectExpr("concat('shoot_', cast(p_size % 6 as string), case when p_partkey % 2 = 0 then '/raw/' else '/jpg/' end, 'IMG_', cast(p_partkey div 4 as string), case when p_partkey % 13 = 0 then ' (1)' when p_partkey % 17 = 0 then ' copy 2' when p_partkey % 19 = 0 then '-copy' else '' end, case p_partkey % 5 when 0 then '.CR3' when 1 then '.jpg' when 2 then '.CR3.xmp' when 3 then '.NEF' else '.txt' end) as path")


_NAMES = """with n as (select concat('shoot_', p_size % 6, case when p_partkey % 2 = 0 then '/raw/' else '/jpg/' end, 'IMG_', p_partkey // 4, case when p_partkey % 13 = 0 then ' (1)' when p_partkey % 17 = 0 then ' copy 2' when p_partkey % 19 = 0 then '-copy' else '' end, case p_partkey % 5 when 0 then '.CR3' when 1 then '.jpg' when 2 then '.CR3.xmp' when 3 then '.NEF' else '.txt' end) as path from part),
f as (select distinct path, regexp_replace(path, '/[^/]*$', '') as dir, lower(regexp_extract(path, '\\.([^./]*)$', 1)) as ext, regexp_extract(path, '([^/]*)$', 1) as base from n),
r as (select *, case when ext in ('cr3', 'nef') then 'raw' when ext = 'jpg' then 'raster' when ext = 'xmp' then 'sidecar' else 'other' end as role, lower(case when ext = 'xmp' then regexp_replace(regexp_replace(base, '\\.[^.]*$', ''), '\\.[^.]*$', '') else regexp_replace(base, '\\.[^.]*$', '') end) as stem from f)"""


@query(_NAMES + " select path, role, dir, stem, ext from r")
def classify_paths(spark, d):
    p = F.col("path")
    return _names(spark, d).distinct().select("path", paths.kind(p).alias("role"), paths.directory(p).alias("dir"), paths.normal_stem(paths.stem(p)).alias("stem"), paths.extension(p).alias("ext"))


@query(_NAMES + """ select path, case when regexp_matches(stem, '^.+ \\([0-9]+\\)$') then regexp_extract(stem, '^(.+) \\([0-9]+\\)$', 1) when stem like '% copy' then left(stem, -5)
 when regexp_matches(stem, '^.+ copy [0-9]+$') then regexp_extract(stem, '^(.+) copy [0-9]+$', 1) when stem like '%-copy' then left(stem, -5) end as base from r""")
def duplicate_markers(spark, d):
    p = F.col("path")
    return _names(spark, d).distinct().select("path", paths.duplicate_base(paths.normal_stem(paths.stem(p))).alias("base"))


_GROUPS = _NAMES + """, g as (select dir, stem, count(*) filter (role = 'raw') as raws, count(*) filter (role = 'raster') as rasters, count(*) filter (role = 'sidecar') as sidecars from r where role != 'other' group by dir, stem),
k as (select *, case when raws = 1 and rasters = 1 then 'pair' when raws = 1 and rasters = 0 then 'raw_only' when raws = 0 and rasters = 1 then 'raster_only' else 'ambiguous' end as state from g where raws + rasters > 0)"""


@query(_GROUPS + """, m as (select *, case when regexp_matches(stem, '^.+ \\([0-9]+\\)$') then regexp_extract(stem, '^(.+) \\([0-9]+\\)$', 1) when stem like '% copy' then left(stem, -5)
 when regexp_matches(stem, '^.+ copy [0-9]+$') then regexp_extract(stem, '^(.+) copy [0-9]+$', 1) when stem like '%-copy' then left(stem, -5) end as base from k),
z as (select m.*, exists (select 1 from k where k.dir = m.dir and k.stem = m.base) as dup from m)
select dir, stem, raws, rasters, sidecars, state, concat_ws(',', case when raws > 1 then 'multiple_raw' end, case when rasters > 1 then 'multiple_raster' end, case when dup then 'possible_duplicate_import' end) as review,
 state = 'ambiguous' or raws > 1 or rasters > 1 or dup as needs_review from z""")
def pair_resolution(spark, d):
    g = resolve.group_files(_names(spark, d), "directory")
    return g.select("dir", "stem", *(F.size(c).cast("long").alias(c) for c in ("raws", "rasters", "sidecars")), "state", F.array_join("review", ",").alias("review"), "needs_review")


@query(_GROUPS + """, h as (select *, regexp_replace(dir, '/[^/]*$', '') as parent from k where state in ('raw_only', 'raster_only')),
one as (select stem, parent, min(dir) as dir from h where state = 'raster_only' group by 1, 2 having count(*) = 1),
first as (select stem, parent, min(dir) as dir from h where state = 'raw_only' group by 1, 2),
mv as (select one.stem, one.dir, first.dir as dest from one join first on one.stem = first.stem and one.parent = first.parent),
moved as (select coalesce(dest, k.dir) as dir, k.stem, raws, rasters from k left join mv on mv.stem = k.stem and mv.dir = k.dir),
s as (select dir, stem, sum(raws)::bigint as raws, sum(rasters)::bigint as rasters from moved group by 1, 2)
select dir, stem, raws, rasters, case when raws = 1 and rasters = 1 then 'pair' when raws = 1 and rasters = 0 then 'raw_only' when raws = 0 and rasters = 1 then 'raster_only' else 'ambiguous' end as state from s""")
def sibling_merge(spark, d):
    return resolve.group_files(_names(spark, d)).select("dir", "stem", F.size("raws").cast("long").alias("raws"), F.size("rasters").cast("long").alias("rasters"), "state")


@query("+ p as (select photo_id, id, role, path, row_number() over (partition by photo_id order by (role != 'raw')::int, id) as k from t_file where role in ('raw', 'raster')) select photo_id, id, role, path from p where k = 1", ("file",))
def primary_pick(spark, d):
    return resolve.primary(frame(spark, d, "file")).select("photo_id", "id", "role", "path")


# the grid ---------------------------------------------------------------------------------------------------------

_VIEW = """+ v as (select p.id, p.dir, p.stem, p.state, s.composite, coalesce(d.rating, 0) as rating, coalesce(d.rejected, false) as rejected, m.camera, m.lens, m.captured_at, m.year, q.focus, q.noise, q.detail,
 case when composite >= 70 then 'keep' when composite < 35 then 'reject' when composite is not null then 'review' end as band
 from t_photo p left join t_score s on s.photo_id = p.id left join t_decision d on d.photo_id = p.id left join t_metadata m on m.photo_id = p.id left join t_quality q on q.photo_id = p.id where p.trashed_at is null)"""
_IN_VIEW = ("photo", "score", "decision", "metadata", "quality")


def _view(spark, d):
    return grid.photo_view(*(frame(spark, d, n) for n in _IN_VIEW))


@query(_VIEW + " select id, dir, stem, band, round(composite, 6) as composite, rating, rejected, camera, lens, year, captured_at, focus, noise, detail from v", _IN_VIEW)
def photo_view(spark, d):
    return _view(spark, d).select("id", "dir", "stem", "band", F.round("composite", 6).alias("composite"), "rating", "rejected", "camera", "lens", "year", "captured_at", "focus", "noise", "detail")


@query(_VIEW + " select id from v where coalesce(band, 'review') = 'review' and rating > 0 and camera = 'BUILDING' and (dir = 'root/1-urgent' or dir like 'root/1-urgent/%')", _IN_VIEW)
def filters_web(spark, d):
    return _view(spark, d).where(grid.Filters("web", band="review", decision="rated", camera="BUILDING", folder="root/1-urgent").predicate()).select("id")


@query(_VIEW + " select id from v where band = 'review' and rating = 0 and not rejected and focus >= 75 and year = 1995 and contains(lower(stem), 'img_1')", _IN_VIEW)
def filters_native(spark, d):
    return _view(spark, d).where(grid.Filters("native", band="review", decision="unrated", quality="sharp", year=1995, search=" ÍMG_1 ").predicate()).select("id")


def _counted(dialect: str) -> str:
    b = "coalesce(band, 'review')" if dialect == "web" else "band"
    named = [("band", x, f"{b} = '{x}'") for x in ("keep", "review", "reject")] + [("decision", "all", "true"), ("decision", "unrated", "rating = 0 and not rejected"), ("decision", "rated", "rating > 0"), ("decision", "rejected", "rejected"), ("quality", "soft", "focus <= 10"), ("quality", "noisy", "noise >= 90"), ("quality", "low_detail", "detail <= 10"), ("quality", "sharp", "focus >= 75")]
    return _VIEW + " " + " union all ".join(f"select '{k}' as kind, '{n}' as name, count(*) filter ({c}) as n from v" for k, n, c in named)


@query(_counted("web"), _IN_VIEW)
def filter_counts_web(spark, d):
    return grid.filter_counts(_view(spark, d), "web")


@query(_counted("native"), _IN_VIEW)
def filter_counts_native(spark, d):
    return grid.filter_counts(_view(spark, d), "native")


@query(_VIEW + " select * from (select 'camera' as facet, camera as value, count(*) as n from v group by 2 union all select 'lens', lens, count(*) from v group by 2 union all select 'year', year::varchar, count(*) from v group by 2) where value is not null and value != ''", _IN_VIEW)
def facets(spark, d):
    return grid.facets(_view(spark, d))


@query(_VIEW + " select id, 'newest' as by, row_number() over (order by captured_at desc nulls last, id) as position from v union all select id, 'oldest', row_number() over (order by captured_at asc nulls last, id) from v", _IN_VIEW)
def sorts_by_time(spark, d):
    v = _view(spark, d).select("id", "captured_at")
    every = [grid.positions(v, by, cutter(spark)).select("id", F.lit(by).alias("by"), "position") for by in ("newest", "oldest")]
    return every[0].union(every[1])


@query(_VIEW + " select id, focus, row_number() over (order by focus desc nulls last, id) as position from v", _IN_VIEW)
def sorts_by_focus(spark, d):
    return grid.positions(_view(spark, d).select("id", "focus"), "sharpest", cutter(spark))


@query(_VIEW + " select id, 'name' as by, row_number() over (order by stem, id) as position from v union all select id, 'name_desc', row_number() over (order by stem desc, id desc) from v", _IN_VIEW)
def sorts_by_name(spark, d):
    v = _view(spark, d).select("id", "stem")
    every = [grid.positions(v, by, cutter(spark)).select("id", F.lit(by).alias("by"), "position") for by in ("name", "name_desc")]
    return every[0].union(every[1])


@query(_VIEW + ", t as (select distinct photo_id from t_decision where rating = 3), u as (select photo_id from t_quality where noise < 50) select id from v where id in (select photo_id from t) and id in (select photo_id from u)", _IN_VIEW)
def narrowing(spark, d):
    return grid.narrow(_view(spark, d), frame(spark, d, "decision").where("rating = 3"), frame(spark, d, "quality").where("noise < 50")).select("id")


@query(_VIEW + ", k as (select id, row_number() over (order by dir, stem) as r from v), e as (select min(r) as a, max(r) as b from k where id in (7, 33)) select id from k, e where r between a and b", _IN_VIEW)
def row_range(spark, d):
    return grid.select_range(_view(spark, d), "ranked", 7, 33).select("id")


@query("""+ c as (select dir, count(*) as k from t_photo where trashed_at is null group by dir), a as (select dir, k, unnest(range(1, len(string_split(dir, '/')) + 1)) as i from c),
u as (select dir, k, array_to_string(string_split(dir, '/')[1:i], '/') as path from a)
select path, coalesce(sum(case when path = dir then k end), 0)::bigint as direct, sum(k)::bigint as recursive from u group by path""", ("photo",))
def folder_rollup(spark, d):
    return grid.directories(frame(spark, d, "photo"))


@query("""+ c as (select dir, count(*) as k from t_photo where trashed_at is null group by dir), a as (select dir, k, unnest(range(1, len(string_split(dir, '/')) + 1)) as i from c),
u as (select dir, k, array_to_string(string_split(dir, '/')[1:i], '/') as path from a)
select substr(path, 6) as path, sum(k)::bigint as recursive from u where path like 'root/%' group by 1""", ("photo",))
def folders_below_root(spark, d):
    return grid.folders_below(grid.directories(frame(spark, d, "photo")), "root").select("path", "recursive")


@query("select doc_id from documents where contains(lower(strip_accents(text)), 'cion') or contains(lower(strip_accents(text)), 'uber')")
def search_ci_ai(spark, d):
    t = F.collate("text", "UNICODE_CI_AI")
    return _read(spark, d, "documents").where(F.contains(t, F.collate(F.lit("CIÓN"), "UNICODE_CI_AI")) | F.contains(t, F.collate(F.lit("über"), "UNICODE_CI_AI"))).select("doc_id")


@query("+ j as (select f.photo_id, f.role, f.id, e.make, e.model, row_number() over (partition by f.photo_id order by (role != 'raw')::int, f.id) as k from t_file f join t_exif e on e.file_id = f.id) select photo_id, id, make, model from j where k = 1", ("file", "exif"))
def first_metadata(spark, d):
    return grid.first_metadata(frame(spark, d, "file"), frame(spark, d, "exif")).select("photo_id", "id", "make", "model")


# tables and work lists --------------------------------------------------------------------------------------------


@query("+ e as (select id, case when id % 3 = 0 then mtime_ns else 0 end as source_mtime_ns, case when id % 7 = 0 then 1 else 2 end as reader_version from t_file where id % 2 = 0) select f.id from t_file f left join e using (id) where role in ('raw', 'raster') and not coalesce(e.source_mtime_ns = f.mtime_ns and reader_version = 2, false)", ("file",))
def stale_exif(spark, d):
    f = frame(spark, d, "file")
    e = f.where("id % 2 = 0").selectExpr("id as file_id", "case when id % 3 = 0 then mtime_ns else 0 end as source_mtime_ns", "case when id % 7 = 0 then 1 else 2 end as reader_version")
    return tables.stale_exif(f, e, 2).select("id")


@query("select id from t_file f where role in ('raw', 'raster') and not exists (select 1 from t_face a where a.file_id = f.id and f.size_bytes < 20000)", ("file", "face"))
def files_needing_faces(spark, d):
    f = frame(spark, d, "file")
    done = frame(spark, d, "face").select("file_id").distinct().join(f.select(F.col("id").alias("file_id"), F.col("size_bytes").alias("detected_size"), F.col("mtime_ns").alias("detected_mtime")), "file_id").where("detected_size < 20000").withColumn("detector", F.lit("x"))
    return tables.files_needing_faces(f, done, "x").select("id")


@query("select id from t_photo p where trashed_at is null and not exists (select 1 from t_tag t where t.photo_id = p.id and t.model = 'm0') order by id limit 150", ("photo", "tag"))
def photos_needing_tags(spark, d):
    return tables.photos_needing_tags(frame(spark, d, "photo"), frame(spark, d, "tag"), "m0", 150).select("id")


@query("select photo_id, path from t_file where id % 3 = 0 and size_bytes % 2000 = 0 union select photo_id, path from t_file where false", ("file",))
def reusable_measurements(spark, d):
    f = frame(spark, d, "file")
    stored = f.where("id % 3 = 0").selectExpr("photo_id", "path as measured_path", "case when size_bytes % 2000 = 0 then size_bytes else -1 end as measured_size", "mtime_ns as measured_mtime")
    return tables.reusable(stored, f).selectExpr("photo_id", "measured_path as path").distinct()


@query("+ o as (select photo_id, rating from t_decision where photo_id % 2 = 0), n as (select photo_id, 9 as rating from t_decision where photo_id % 5 = 0) select photo_id, rating from o where photo_id not in (select photo_id from n) union all select * from n", ("decision",))
def upsert_rows(spark, d):
    x = frame(spark, d, "decision").select("photo_id", "rating")
    return tables.upsert(x.where("photo_id % 2 = 0"), x.where("photo_id % 5 = 0").withColumn("rating", F.lit(9)), ["photo_id"])


@query("""with a as (select o_orderkey as k from orders where o_orderkey % 3 != 0), b as (select o_orderkey as k from orders where o_orderkey % 4 != 0)
select k, case when a.k is null then 'appeared' when b.k is null then 'vanished' else 'kept' end as change from a full join b using (k)""")
def mark_sweep_diff(spark, d):
    o = _read(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    return tables.diff(o.where("k % 3 != 0"), o.where("k % 4 != 0"), ["k"])


@query("""+ o as (select id, path, size_bytes, mtime_ns, concat('h', id) as content_hash from t_file where id % 3 != 0), n as (select path, photo_id, case when id % 5 = 0 then size_bytes + 1 else size_bytes end as size_bytes, mtime_ns from (select *, row_number() over (partition by path order by id) as k from t_file where id % 4 != 1) where k = 1),
o1 as (select *, row_number() over (partition by path order by id) as k from o), l as (select max(id) as last from o1 where k = 1),
j as (select n.*, o1.id as oid, o1.size_bytes as os, o1.mtime_ns as om, content_hash from n left join (select * from o1 where k = 1) o1 using (path)),
f as (select path, row_number() over (order by path) as nid from j where oid is null)
select j.path, coalesce(oid, last + nid) as id, case when os = size_bytes and om = mtime_ns then content_hash end as content_hash from j left join f using (path), l""", ("file",))
def reconcile_files(spark, d):
    f = frame(spark, d, "file")
    # ids repeat in the test data with other sizes and times; both sides take the same row of them, as the SQL does
    first = F.row_number().over(Window.partitionBy("path").orderBy("id", "size_bytes", "mtime_ns"))
    old = f.where("id % 3 != 0").withColumn("k", first).where("k = 1").selectExpr("id", "path", "size_bytes", "mtime_ns", "concat('h', cast(id as string)) as content_hash")
    new = f.where("id % 4 != 1").withColumn("k", first).where("k = 1").selectExpr("path", "photo_id", "role", "case when id % 5 = 0 then size_bytes + 1 else size_bytes end as size_bytes", "mtime_ns")
    return tables.reconcile_files(old, new, 0, cutter(spark)).select("path", "id", "content_hash")


# people and tags --------------------------------------------------------------------------------------------------


@query("+ f as (select id, file_id, person_id from t_face), p as (select distinct person_id from f union select 999) select p.person_id, count(f.id) as faces, count(distinct x.photo_id) as photos from p left join f using (person_id) left join t_file x on x.id = f.file_id group by 1", ("face", "file"))
def people_counts(spark, d):
    f = frame(spark, d, "face")
    people = f.select(F.col("person_id").cast("long").alias("id")).distinct().union(spark.range(999, 1000))
    return tables.people_counts(people, f.select("person_id", F.col("id").alias("face_id")), f.select("id", "file_id"), frame(spark, d, "file"))


@query("+ f as (select id as face_id, person_id::bigint as person_id from t_face union select id, 2 from t_face where person_id = 1 and id % 3 = 0) select distinct case when person_id = 1 then 2 else person_id end as person_id, face_id from f", ("face",))
def merge_people(spark, d):
    f = frame(spark, d, "face").selectExpr("cast(person_id as long) as person_id", "id as face_id")
    f = f.union(f.where("person_id = 1 and face_id % 3 = 0").withColumn("person_id", F.lit(2).cast("long")))
    return tables.merge_people(f, 1, 2)[0]


@query("select case when person_id = 3 and id % 2 = 0 then (select max(person_id) + 1 from t_face) else person_id end::bigint as person_id, id as face_id from t_face", ("face",))
def split_person(spark, d):
    f = frame(spark, d, "face").selectExpr("cast(person_id as long) as person_id", "id as face_id")
    people = f.select(F.col("person_id").alias("id")).distinct().selectExpr("id", "cast(null as string) as name", "false as confirmed", "0L as created_at", "0L as updated_at")
    return tables.split_person(people, f, 3, f.where("face_id % 2 = 0").select("face_id"), 9)[1]


@query("+ v as (select id from t_photo where trashed_at is null) select lower(trim(name)) as name, count(distinct photo_id) as n from t_tag where model = 'm0' and photo_id in (select id from v) group by 1", ("tag", "photo"))
def tag_counts(spark, d):
    return tables.tag_counts(frame(spark, d, "tag").withColumn("name", media.tag_name(F.col("name"))), frame(spark, d, "photo"), "m0")


@query("select photo_id, lower(trim(name)) as name, max(confidence) as confidence from t_tag group by 1, 2", ("tag",))
def tag_dedupe(spark, d):
    return tables.dedupe_tags(frame(spark, d, "tag"))


@query("+ o as (select photo_id, lower(trim(name)) as name, max(confidence) as confidence, model from t_tag group by 1, 2, 4) select photo_id, name, confidence, model from o where not (model = 'm0' and photo_id % 10 = 0) union all select distinct photo_id, 'new', 0.5::double, 'm0' from t_tag where photo_id % 10 = 0", ("tag",))
def replace_tags(spark, d):
    t = frame(spark, d, "tag")
    old = t.groupBy("photo_id", media.tag_name(F.col("name")).alias("name"), "model").agg(F.max("confidence").alias("confidence"))
    photos = t.where("photo_id % 10 = 0").select("photo_id").distinct()
    new = photos.select("photo_id", F.lit(" New").alias("name"), F.lit(0.5).alias("confidence"))
    return tables.replace_tags(old, new, photos, "m0")


# vectors ----------------------------------------------------------------------------------------------------------


@query("""+ p as (select a.id as src, b.id as dst, list_cosine_similarity(a.vector::double[], b.vector::double[]) as s from t_face a join t_face b on a.id < b.id),
k as (select *, row_number() over (partition by src order by s desc, dst) as r from p where s >= 0.3) select src, dst, round(s, 6) as weight from k where r <= 8""", ("face",))
def knn_graph(spark, d):
    return vectors.knn_graph(frame(spark, d, "face").select("id", "vector"), cutter(spark), block=256).withColumn("weight", F.round("weight", 6))


@query()
def whispers_clusters(spark, d):
    return vectors.clusters(vectors.knn_graph(frame(spark, d, "face").select("id", "vector"), cutter(spark), block=256), cutter(spark))


@query("""+ x as (select person_id, unnest(range(64)) as i, unnest(vector::double[]) as x from t_face), m as (select person_id, i, avg(x) as x from x group by 1, 2),
c as (select person_id as p, list(x order by i) as c from m group by 1), s as (select id, person_id, p, list_cosine_similarity(vector::double[], c) as s from t_face, c),
o as (select id as face_id, person_id, max(s) filter (p = person_id) as own, max(s) filter (p != person_id) as other from s group by 1, 2)
select face_id, person_id, round(own, 6) as own, round(other, 6) as other from o where other > 0 and own - other < 0.12""", ("face",))
def ambiguous_faces(spark, d):
    return vectors.ambiguous(frame(spark, d, "face").selectExpr("id as face_id", "person_id", "vector")).select("face_id", "person_id", F.round("own", 6).alias("own"), F.round("other", 6).alias("other"))


@query("""+ r as (select person_id as label, case when id % 11 != 0 then id % 7 end as cluster from t_face), n as (select label, cluster, count(*) as n from r group by 1, 2),
t as (select sum(n * (n - 1) / 2) as tp from n where cluster is not null), c as (select sum(n * (n - 1) / 2) as c from (select sum(n) as n from n where cluster is not null group by cluster)), l as (select sum(n * (n - 1) / 2) as l from (select sum(n) as n from n group by label)),
v as (select tp, c - tp as fp, l - tp as fn, tp / c as p, tp / l as r from t, c, l)
select tp, fp, fn, round(p, 9) as precision, round(r, 9) as recall, round(2 * p * r / (p + r), 9) as f1 from v""", ("face",))
def cluster_eval_pairs(spark, d):
    r = vectors.pair_metrics(frame(spark, d, "face").selectExpr("person_id as label", "case when id % 11 != 0 then id % 7 end as cluster"))
    return r.select("tp", "fp", "fn", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query("""+ f as (select id, vector::double[] as v, person_id as label, id % 20 as c from t_face), p as (select a.id, (a.label = b.label)::int as same, row_number() over (partition by a.id order by list_cosine_similarity(a.v, b.v) desc, b.id) as k from f a join f b on a.c = b.c and a.id != b.id),
m as (select id, avg(same) as share from p where k <= 3 group by id) select round(avg(share), 6) as purity from m where (select min(n) from (select count(*) as n from f group by c)) >= 4""", ("face",))
def neighbour_purity(spark, d):
    return vectors.neighbour_purity(frame(spark, d, "face").selectExpr("id", "vector", "person_id as label", "id % 20 as cluster")).select(F.round("purity", 6).alias("purity"))


@query("""+ v as (select concat('phrase ', id) as phrase, vector as y from t_face where id < 40), s as (select f.id as photo_id, phrase, list_dot_product(vector::double[], y::double[]) as s from t_face f, v),
k as (select *, row_number() over (partition by photo_id order by s desc, phrase) as r from s where s >= 0.2) select photo_id, phrase, round(s, 6) as similarity from k where r <= 5""", ("face",))
def vocabulary_rank(spark, d):
    f = frame(spark, d, "face")
    v = f.where("id < 40").selectExpr("concat('phrase ', cast(id as string)) as phrase", "vector")
    return vectors.rank_vocabulary(f.selectExpr("id as photo_id", "vector"), v).withColumn("similarity", F.round("similarity", 6))


@query()
def suppress_boxes(spark, d):
    return vectors.suppress(_read(spark, d, "lineitem").selectExpr("l_orderkey % 50 as image", "l_orderkey * 8 + l_linenumber as id", "l_quantity as x", "l_partkey % 50 / 1e0 as y", "10e0 as w", "10e0 as h", "l_extendedprice as confidence"))


# scalar rules -----------------------------------------------------------------------------------------------------


@query("""select o_orderkey, epoch(date_trunc('second', strptime(strftime(o_orderdate, '%Y-%m-%d'), '%Y-%m-%d')))::bigint + (o_orderkey % 24) * 3600 + (o_orderkey % 60) * 60 + o_orderkey % 60 as t, strftime(o_orderdate, '%Y-%m-%d') as day from orders""")
def exif_datetime(spark, d):
    o = _read(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy:MM:dd").alias("x"))
    part = F.format_string("%02d:%02d:%02d.25", F.col("o_orderkey") % 24, F.col("o_orderkey") % 60, F.col("o_orderkey") % 60)
    t = media.exif_time(F.concat(F.lit(" "), F.col("x"), F.lit(" "), part))
    return o.select("o_orderkey", t.alias("t"), media.civil_date(t).alias("day"))


@query("""select distinct p_brand, p_size % 3 as k, case when p_size % 3 = 0 then p_type when lower(p_type) like concat(lower(p_brand), '%') then p_type else concat(p_brand, ' ', p_type) end as camera, p_type from part where p_brand not like '% %'""")
def camera_names(spark, d):
    p = _read(spark, d, "part").where("p_brand not like '% %'")
    make = F.when(F.col("p_size") % 3 == 0, F.lit("  ")).otherwise(F.col("p_brand"))
    return p.select("p_brand", (F.col("p_size") % 3).alias("k"), media.camera_name(make, F.concat(F.col("p_type"), F.lit(" "))).alias("camera"), "p_type").distinct()


@query("""select l_linenumber, q, concat(q, case when q % 100 between 11 and 13 then 'th' when q % 10 = 1 then 'st' when q % 10 = 2 then 'nd' when q % 10 = 3 then 'rd' else 'th' end) as o, case when q >= 70 then 'keep' when q < 35 then 'reject' else 'review' end as band
 from (select distinct l_linenumber, (l_quantity * 2)::int as q from lineitem)""")
def ordinals(spark, d):
    r = _read(spark, d, "lineitem").select("l_linenumber", (F.col("l_quantity") * 2).cast("int").alias("q")).distinct()
    return r.select("l_linenumber", "q", media.ordinal(F.col("q").cast("double")).alias("o"), media.band(F.col("q")).alias("band"))


@query("""with u as (select page_id, case page_id % 6 when 0 then url when 1 then concat('http://10.0.', page_id % 256, '.7/x') when 2 then concat('http://172.', page_id % 64, '.0.1:8000/') when 3 then concat('https://user@github.com:443/', page_id) when 4 then concat('http://100.', page_id % 256, '.0.1') else 'http://[::1]/x' end as url from pages)
select page_id, case page_id % 6 when 0 then false when 1 then true when 2 then page_id % 64 between 16 and 31 when 3 then true when 4 then page_id % 256 between 64 and 127 else true end as ok from u""")
def egress_check(spark, d):
    u = _read(spark, d, "pages").selectExpr("page_id", "case page_id % 6 when 0 then url when 1 then concat('http://10.0.', cast(page_id % 256 as string), '.7/x') when 2 then concat('http://172.', cast(page_id % 64 as string), '.0.1:8000/') when 3 then concat('https://user@github.com:443/', cast(page_id as string)) when 4 then concat('http://100.', cast(page_id % 256 as string), '.0.1') else 'http://[::1]/x' end as url")
    return u.select("page_id", media.permits(F.col("url")).alias("ok"))


@query("""select s_suppkey, case when s_suppkey % 9 = 0 then 'remote' when s_suppkey % 4 = 0 then case when s_suppkey % 40 * 0.7 >= 20 then 'local_large' when s_suppkey % 40 * 0.7 >= 12 then 'local_mid' when s_suppkey % 40 * 0.7 >= 6 then 'local_small' else 'cpu_only' end
 when s_suppkey % 30 >= 20 then 'local_large' when s_suppkey % 30 >= 12 then 'local_mid' when s_suppkey % 30 >= 6 then 'local_small' else 'cpu_only' end as tier from supplier""")
def hardware_tiers(spark, d):
    k, gib = F.col("s_suppkey"), 1 << 30
    return _read(spark, d, "supplier").select("s_suppkey", media.hardware_tier(k % 9 == 0, F.when(k % 4 != 0, (k % 30) * gib), (k % 40) * gib, k % 4 == 0).alias("tier"))


# operations and streams -------------------------------------------------------------------------------------------


@query("""with m as (select event_id as op_id, (event_id * 17) % 1000 as "at", 1 + (props->>'$.k')::bigint % 3 as n, (props->>'$.k')::bigint as k from events)
select concat('op', op_id) as op_id, "at", n as files, n * greatest(k - 5, 0) as bytes, op_id % 13 = 0 as purged from m""")
def trash_oplog(spark, d):
    m = _read(spark, d, "events").selectExpr("concat('op', cast(event_id as string)) as op_id", "(event_id * 17) % 1000 as at", "event_id", "cast(get_json_object(props, '$.k') as bigint) as k")
    files = F.transform(F.sequence(F.lit(1).cast("long"), 1 + F.col("k") % 3), lambda i: F.struct(F.lit("s").alias("source"), F.lit("d").alias("destination"), (F.col("k") - 5).alias("size"), F.lit(None).cast("string").alias("expected_hash")))
    moves = m.select("op_id", "at", F.lit("trash").alias("action"), F.lit("").alias("reason"), files.alias("files"))
    purges = m.where("event_id % 13 = 0").select(F.concat("op_id", F.lit("-purged")).alias("op_id"), "at", F.lit("purge").alias("action"), F.lit("").alias("reason"), files.alias("files"))
    return tables.operations(moves.union(purges)).select("op_id", "at", "files", "bytes", "purged")


@query("""+ i as (select distinct event_id * 3 as photo_id from events), f as (select photo_id, count(*) as files, sum(greatest(size_bytes, 0))::bigint as bytes from t_file group by 1)
select i.photo_id, p.stem, coalesce(files, 0) as files, coalesce(bytes, 0) as bytes, coalesce(state in ('raw_only', 'raster_only'), false) as incomplete, files is null as missing from i left join t_photo p on p.id = i.photo_id left join f on f.photo_id = i.photo_id""", ("photo", "file"))
def delete_selection(spark, d):
    return tables.delete_selection(_read(spark, d, "events").selectExpr("event_id * 3 as photo_id"), frame(spark, d, "photo"), frame(spark, d, "file"))


@query("+ x as (select path, id, size_bytes as size, (id * 7919) % 1000000 as mtime from t_file), y as (select *, sum(size) over (order by mtime, path, id rows unbounded preceding) as acc, sum(size) over () as total from x) select id from y where total - (acc - size) > 100000000", ("file",))
def cache_eviction(spark, d):
    c = frame(spark, d, "file").selectExpr("concat(path, lpad(cast(id as string), 12, '0')) as path", "id", "size_bytes as size", "(id * 7919) % 1000000 as mtime")
    return tables.evicted(c, 100_000_000).select("id")


@query("""+ p as (select photo_id, path, role, row_number() over (partition by photo_id order by (role != 'raw')::int, id) as k from t_file where role in ('raw', 'raster'))
select p.id as photo_id, case when d.rating is null then 'no_decision' when d.rating = 0 and not d.rejected then 'unrated' when x.path is null then 'no_file' else 'write' end as status from t_photo p left join t_decision d on d.photo_id = p.id left join (select * from p where k = 1) x on x.photo_id = p.id where trashed_at is null""", ("photo", "decision", "file"))
def sidecar_export(spark, d):
    return sidecar_plan(frame(spark, d, "photo"), frame(spark, d, "decision"), resolve.primary(frame(spark, d, "file"))).select("photo_id", "status")


@query("""+ e as (select event_id, concat('u', user_id) as path, case when event_type = 'view' then 'vanished' else 'appeared' end as change, epoch_us(ts) // 1000000 as "at" from events), n as (select *, coalesce(lead("at") over (partition by path order by "at", event_id), 2000000000) as nx from e) select path, change, "at" from n where nx - "at" >= 3000""", ("frames",))
def settle_debounce(spark, d):
    e = _read(spark, d, "events").selectExpr("event_id", "concat('u', cast(user_id as string)) as path", "case when event_type = 'view' then 'vanished' else 'appeared' end as change", "timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts) as at")
    return settle.settled_batch(e, 2_000_000_000, 3000).select("path", "change", "at")


@query("""+ p as (select * from t_photo where trashed_at is null), s as (select photo_id from t_score where photo_id in (select id from p)), f as (select * from t_file where photo_id in (select id from p)),
r as (select count(*) as photos, (select count(*) from s) as scored, (select count(*) from f) as files, (select count(*) from s where photo_id % 4 = 0) as reused, count(*) filter (id % 50 = 0) as review, count(*) filter (state = 'ambiguous') as amb from p)
select 'photographs have files' as problem from r where files < photos union all select 'bands make up the scored' from r where (select count(*) from s where photo_id % 7 = 0) > 0
 union all select 'states make up the photographs' from p where state not in ('pair', 'raw_only', 'raster_only', 'ambiguous') group by 1 union all select 'the ambiguous need review' from r where review < amb
 union all select 'only the scored are reused' from r where reused > scored""", ("photo", "score", "file"))
def report_problems(spark, d):
    photos = frame(spark, d, "photo").withColumn("needs_review", F.col("id") % 50 == 0)
    scored = frame(spark, d, "score").select("photo_id", F.when(F.col("photo_id") % 7 == 0, "unknown").when(F.col("composite") >= 50, "keep").otherwise("review").alias("band"))
    shoots = photos.select((F.col("id") % 100).alias("shoot_id"))
    return tables.inconsistencies(indexing.report(photos, frame(spark, d, "file"), scored, shoots, scored.where("photo_id % 4 = 0").select("photo_id")))


@query("""with r as (select conv_id, count(*) as n, sum(length(text)) as c from conversations group by 1) select bool_and(n <= 6) as adheres, sum(greatest(0, c - 12 * n))::bigint as wasted, 3600.0 * count(*) / sum(n * 2.0) as per_hour from r""")
def endpoint_usage(spark, d):
    words = ["t1", "t2", "t3", "t4", "t5", "t6"]
    r = _read(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("completion_tokens"))
    r = r.withColumns({"tags": F.transform(F.sequence(F.lit(1).cast("long"), F.col("n")), lambda i: F.concat(F.lit("t"), i.cast("string"))), "seconds": F.col("n") * 2.0})
    return tables.endpoint_usage(r, words)


@query("select (select count(*) from t_photo where trashed_at is null) as photos, (select count(distinct dir) from t_photo where trashed_at is null) as folders, (select count(distinct lower(trim(name))) from t_tag) as tags, (select count(*) from t_score) as scored", ("photo", "tag", "score"))
def photo_totals(spark, d):
    """The stats command: photographs, folders, named groups, tags, scored."""
    p = frame(spark, d, "photo").where("trashed_at is null").agg(F.count("*").alias("photos"), F.count_distinct("dir").alias("folders"))
    t = frame(spark, d, "tag").agg(F.count_distinct(media.tag_name(F.col("name"))).alias("tags"))
    s = frame(spark, d, "score").agg(F.count_distinct("photo_id").alias("scored"))
    return p.crossJoin(t).crossJoin(s)  # one row each
