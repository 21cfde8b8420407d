"""Queries of catalog changes and reads, each with the DuckDB SQL it must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from fotolith.functions import devices, media
from fotolith.operators import decisions, grid, indexing, people, reads, sessions, tables, trash, vectors
from fotolith.plans.checkpoint import cutter
from fotolith.plans.datasets import frame
from fotolith.plans.queries import _IN_VIEW, _VIEW, _read, _view, query
from fotolith.sources import thumbs
from fotolith.streaming import progress

# decisions --------------------------------------------------------------------------------------------------------

_IDENTITY = "i as (select photo_id, size_bytes as s, mtime_ns as m from (select *, row_number() over (partition by photo_id order by (role != 'raw')::int, id, size_bytes, mtime_ns) as k from t_file where role in ('raw', 'raster')) where k = 1)"


def _decisions(spark, d):
    return frame(spark, d, "decision").withColumns({"decided_at": F.lit(1).cast("long"), "source_size": F.lit(5).cast("long"), "source_mtime": F.lit(6).cast("long")})


@query(f"""+ {_IDENTITY}, n as (select distinct photo_id, (photo_id % 4)::int as rating, photo_id % 5 = 0 as rejected from t_file where photo_id % 7 = 0)
select photo_id, rating, rejected, 1::bigint as decided_at, 5::bigint as source_size, 6::bigint as source_mtime from t_decision where photo_id not in (select photo_id from n) union all select photo_id, rating, rejected, 9, s, m from n left join i using (photo_id)""", ("decision", "file"))
def set_decision(spark, d):
    f = frame(spark, d, "file")
    new = f.where("photo_id % 7 = 0").select("photo_id").distinct().selectExpr("photo_id", "cast(photo_id % 4 as int) as rating", "photo_id % 5 = 0 as rejected")
    return decisions.set_decisions(_decisions(spark, d), f, new, 9)[0]


@query("+ n as (select distinct photo_id from t_file where photo_id % 7 = 0) select photo_id, coalesce(rating, 0) as rating, coalesce(rejected, false) as rejected from n left join t_decision using (photo_id)", ("decision", "file"))
def previous_decision(spark, d):
    f = frame(spark, d, "file")
    new = f.where("photo_id % 7 = 0").select("photo_id").distinct().selectExpr("photo_id", "1 as rating", "false as rejected")
    return decisions.set_decisions(_decisions(spark, d), f, new, 9)[1]


@query(f"+ {_IDENTITY} select photo_id, case when photo_id % 2 = 0 then s else 5 end as source_size, case when photo_id % 2 = 0 then m else 6 end as source_mtime from t_decision left join i using (photo_id)", ("decision", "file"))
def remember_identity(spark, d):
    x = _decisions(spark, d)
    return decisions.remember_identities(x, frame(spark, d, "file"), x.where("photo_id % 2 = 0").select("photo_id")).select("photo_id", "source_size", "source_mtime")


@query("select count(*) as n from t_decision where rating > 0 or rejected", ("decision",))
def decision_count(spark, d):
    return decisions.decision_count(frame(spark, d, "decision"))


@query("select photo_id from t_decision where photo_id % 5 != 0 and photo_id not in (select id from t_photo where id % 2 = 0)", ("decision", "photo"))
def orphaned_decisions(spark, d):
    x = _decisions(spark, d).withColumn("source_size", F.when(F.col("photo_id") % 5 != 0, F.col("source_size")))
    return decisions.orphaned(x, frame(spark, d, "photo").where("id % 2 = 0")).select("photo_id")


@query("""+ recursive d as (select photo_id, min(size_bytes) as s, row_number() over (order by photo_id) as turn from t_file where photo_id % 2 = 0 group by photo_id),
h as (select photo_id as heir_id, size_bytes as s, min((role != 'raw')::int) as r from t_file where photo_id % 2 = 1 and role in ('raw', 'raster') group by 1, 2),
o as (select s, heir_id, row_number() over (partition by s order by r, heir_id) as k from h),
w(turn, taken, photo_id, heir_id) as (select 0::bigint, []::bigint[], null::bigint, null::bigint
  union all select turn, case when h is null then taken else list_append(taken, h) end, photo_id, h from (select d.turn, w.taken, d.photo_id, (select min_by(o.heir_id, o.k) from o where o.s = d.s and not list_contains(w.taken, o.heir_id)) as h from w join d on d.turn = w.turn + 1))
select photo_id, heir_id from w where heir_id is not null""", ("file",))
def orphan_adoption(spark, d):
    f = frame(spark, d, "file")
    doomed = f.where("photo_id % 2 = 0").groupBy("photo_id").agg(F.min("size_bytes").alias("source_size")).withColumn("source_mtime", F.lit(7).cast("long"))
    heirs = f.where("photo_id % 2 = 1").select("photo_id", "role", "size_bytes", F.lit(7).cast("long").alias("mtime_ns"))
    return decisions.adopt(doomed, heirs, cutter(spark))


# faces and people -------------------------------------------------------------------------------------------------


@query("select x.photo_id, count(*) as faces from t_face f join t_file x on x.id = f.file_id join t_photo p on p.id = x.photo_id where p.trashed_at is null group by 1", ("face", "file", "photo"))
def face_counts(spark, d):
    return people.face_counts(frame(spark, d, "face"), frame(spark, d, "file"), frame(spark, d, "photo"))


@query("select f.id as face_id, x.photo_id from t_face f join t_file x on x.id = f.file_id join t_photo p on p.id = x.photo_id where p.trashed_at is null and not (f.id % 3 = 0 or f.id % 7 = 0)", ("face", "file", "photo"))
def faces_needing_embeddings(spark, d):
    f = frame(spark, d, "face")
    have = f.where("id % 3 = 0 or id % 7 = 0").select(F.col("id").alias("face_id"), "vector", F.lit("m").alias("model")).union(f.select("id", "vector", F.lit("other")))
    return people.faces_needing_embeddings(f, frame(spark, d, "file"), frame(spark, d, "photo"), have, "m")


@query("""+ f as (select file_id, row_number() over (partition by file_id order by id) - 1 as place, id from t_face), n as (select file_id, place, row_number() over (order by file_id, place) as k from f where file_id % 2 = 0 and place < 2)
select id, file_id, 'old' as detector from t_face where file_id % 2 = 1 union all select (select max(id) from t_face) + k, file_id, 'new' from n""", ("face",))
def replace_faces(spark, d):
    f = frame(spark, d, "face")
    old = f.select("id", "file_id", *(F.lit(0.0).alias(c) for c in ("x", "y", "width", "height", "confidence")), F.array().cast("array<float>").alias("landmarks"), F.lit(0).cast("long").alias("detected_size"), F.lit(0).cast("long").alias("detected_mtime"), F.lit("old").alias("detector"), F.lit(0).cast("long").alias("detected_at"))
    box = F.struct(*(F.lit(1.0).alias(c) for c in ("x", "y", "width", "height", "confidence")))
    # up to two landmark lists a file, however many boxes there are
    found = f.where("file_id % 2 = 0").groupBy("file_id").agg(F.collect_list(box).alias("boxes")).withColumns({"landmarks": F.array_repeat(F.array().cast("array<float>"), 2), "size": F.lit(1).cast("long"), "mtime": F.lit(2).cast("long")})
    return people.replace_faces(old, found, "new", 3).select("id", "file_id", "detector")


def _people(spark, d):
    return frame(spark, d, "face").select(F.col("person_id").cast("long").alias("id")).distinct().selectExpr("id", "concat('p', cast(id as string)) as name", "id % 2 = 0 as confirmed", "1L as updated_at")


@query("select distinct person_id::bigint as id, case when person_id = 3 then 'Ada' when person_id = 4 then null else concat('p', person_id) end as name, person_id % 2 = 0 or person_id in (3, 4) as confirmed, case when person_id in (3, 4) then 9 else 1 end::bigint as updated_at from t_face", ("face",))
def name_person(spark, d):
    return people.name_person(people.name_person(_people(spark, d), 3, "  Ada ", 9), 4, "  ", 9)


@query("select id as face_id, person_id::bigint as person_id from t_face where person_id != 5", ("face",))
def delete_person(spark, d):
    f = frame(spark, d, "face").select(F.col("person_id").cast("long").alias("person_id"), F.col("id").alias("face_id"))
    return people.delete_person(_people(spark, d), f, 5)[1]


@query("select distinct x.photo_id from t_face f join t_file x on x.id = f.file_id where f.person_id = 2", ("face", "file"))
def photos_of_person(spark, d):
    f = frame(spark, d, "face")
    return people.photos_of_person(f.select(F.col("person_id").cast("long").alias("person_id"), F.col("id").alias("face_id")), f, frame(spark, d, "file"), 2)


@query("select id, round(list_min(list_transform(range(5), lambda i: v[2 * i + 1])), 6) as x, round(list_min(list_transform(range(5), lambda i: v[2 * i + 2])), 6) as y, round(list_max(list_transform(range(5), lambda i: v[2 * i + 1])) - list_min(list_transform(range(5), lambda i: v[2 * i + 1])), 6) as w from (select id, vector::double[][1:10] as v from t_face) where id % 2 = 0 union all select id, null, null, null from t_face where id % 2 = 1".replace("vector::double[][1:10]", "(vector::double[])[1:10]"), ("face",))
def landmark_boxes(spark, d):
    marks = F.when(F.col("id") % 2 == 0, F.slice("vector", 1, 10)).otherwise(F.slice("vector", 1, 8))
    box = people.landmark_box(marks)
    return frame(spark, d, "face").select("id", F.round(box["x"], 6).alias("x"), F.round(box["y"], 6).alias("y"), F.round(box["width"], 6).alias("w"))


# reads ------------------------------------------------------------------------------------------------------------


@query("select p.id as photo_id, coalesce(e.model, e.make, '') as camera, f.mtime_ns % 1000 as captured_at from t_photo p join t_file f on f.photo_id = p.id and f.role = 'raw' join t_exif e on e.file_id = f.id where f.mtime_ns % 1000 is not null", ("photo", "file", "exif"))
def capture_times(spark, d):
    f = frame(spark, d, "file")
    e = frame(spark, d, "exif").join(f.select(F.col("id").alias("file_id"), (F.col("mtime_ns") % 1000).alias("captured_at")).dropDuplicates(["file_id"]), "file_id")
    return reads.capture_times(frame(spark, d, "photo"), f, e)


_SCORES = """s as (select photo_id, 'composite' as metric, composite as value from t_score union all select photo_id, 'band', case when composite >= 30 then 2.0 when composite >= 15 then 1.0 else 0.0 end from t_score
 union all select photo_id, 'shoot_size', (photo_id % 20)::double from t_score union all select photo_id, 'shoot_relative', (photo_id % 20 >= 8)::int::double from t_score union all select photo_id, 'term:' || t, ((photo_id * k) % 101)::double from t_score, (values ('focus', 3), ('tonal_range', 5), ('noise', 7), ('detail', 11), ('clipping', 13)) x(t, k) where photo_id % 3 != 0)"""


def _scores(spark, d):
    s = frame(spark, d, "score")
    one = s.selectExpr("photo_id", """explode(array(named_struct('metric', 'composite', 'value', composite), named_struct('metric', 'band', 'value', case when composite >= 30 then 2e0 when composite >= 15 then 1e0 else 0e0 end),
      named_struct('metric', 'shoot_size', 'value', cast(photo_id % 20 as double)), named_struct('metric', 'shoot_relative', 'value', cast(cast(photo_id % 20 >= 8 as int) as double)))) as x""")
    terms = s.where("photo_id % 3 != 0").selectExpr("photo_id", "explode(array(" + ", ".join(f"named_struct('metric', 'term:{t}', 'value', cast((photo_id * {k}) % 101 as double))" for t, k in (("focus", 3), ("tonal_range", 5), ("noise", 7), ("detail", 11), ("clipping", 13))) + ")) as x")
    return one.union(terms).select("photo_id", "x.metric", "x.value", F.lit("v").alias("scorer_version"))


@query(f"""+ {_SCORES}, n as (select photo_id, max(value) filter (metric = 'composite') as c, max(value) filter (metric = 'band') as b, string_agg(replace(substr(metric, 6), '_', ' ') || '=' || value::bigint, ';' order by metric) filter (metric like 'term:%') as terms from s group by photo_id),
f as (select photo_id, count(*) as files, sum(size_bytes)::bigint as bytes, list(parse_filename(path) order by role, path)[1] as first_name from t_file group by photo_id),
e as (select photo_id, case when lower(model) like lower(make) || '%' then model else make || ' ' || model end as camera from (select f.photo_id, make, model, row_number() over (partition by f.photo_id order by (role != 'raw')::int, f.id) as k from t_file f join t_exif x on x.file_id = f.id) where k = 1)
select p.id as photo_id, p.stem, coalesce(files, 0) as files, bytes, first_name, camera, round(c, 6) as composite, case b when 2 then 'keep' when 1 then 'review' when 0 then 'reject' end as band, coalesce(terms, '') as terms, coalesce(rating, 0) as rating, coalesce(rejected, false) as rejected
from t_photo p left join f on f.photo_id = p.id left join e on e.photo_id = p.id left join n on n.photo_id = p.id left join t_decision d on d.photo_id = p.id""", ("photo", "file", "exif", "score", "decision"))
def photo_detail(spark, d):
    e = frame(spark, d, "exif").withColumns({c: F.lit(None).cast("double") for c in ("lens", "iso", "f_number", "exposure_time", "focal_length", "captured_at")})
    p = frame(spark, d, "photo").withColumn("needs_review", F.lit(False))
    rows = reads.photo_details(p, frame(spark, d, "file"), e, _scores(spark, d), frame(spark, d, "decision"), "v")
    total = F.aggregate("files", F.lit(0).cast("long"), lambda a, f: a + f["size_bytes"])
    terms = F.array_join(F.transform("terms", lambda t: F.concat(t["label"], F.lit("="), t["percentile"].cast("long").cast("string"))), ";")
    return rows.select("photo_id", "stem", F.size("files").cast("long").alias("files"), F.when(F.size("files") > 0, total).alias("bytes"), F.get("files", F.lit(0))["name"].alias("first_name"), "camera", F.round("composite", 6).alias("composite"), "band", terms.alias("terms"), "rating", "rejected")


@query(f"""+ {_SCORES}, t as (select photo_id, metric, value, row_number() over (partition by photo_id order by metric) as k from s where metric like 'term:%'), x as (select photo_id, string_agg('  ' || replace(substr(metric, 6), '_', ' ') || ': ' || value::bigint || 'th percentile', chr(10) order by metric) as l from t where k <= 4 group by 1),
n as (select photo_id, max(value) filter (metric = 'shoot_size')::bigint as z, max(value) filter (metric = 'shoot_relative') as r, max(value) filter (metric = 'band') as b from s group by 1)
select p.id as photo_id, case when n.photo_id is null then 'not scored' else (case b when 2 then 'Keep' when 1 then 'Review' else 'Reject' end) || ' (ranked ' || case when r > 0.5 then 'of ' || z || ' in this shoot' else 'across the library; this shoot has only ' || z || ' frames' end || ')' || coalesce(chr(10) || l, '') end as lines from t_photo p left join n on n.photo_id = p.id left join x on x.photo_id = p.id""", ("photo", "score"))
def explain_photo(spark, d):
    rows = reads.explained(frame(spark, d, "photo"), _scores(spark, d), "v")
    return rows.select("photo_id", F.regexp_replace(F.array_join("lines", "\n"), "— [0-9]+/100 ", "").alias("lines"))


@query("select count(distinct photo_id) as n from t_score where photo_id in (select id from t_photo where trashed_at is null)", ("score", "photo"))
def scored_count(spark, d):
    return reads.scored_count(_scores(spark, d), frame(spark, d, "photo"))


@query("select (select count(*) from t_photo where trashed_at is null) as photos, (select count(distinct dir) from t_photo where trashed_at is null) as folders, (select count(distinct person_id) from t_face) as groups, (select count(distinct person_id) from t_face) as named, (select count(distinct name) from t_tag where photo_id in (select id from t_photo where trashed_at is null)) as tags, (select count(distinct photo_id) from t_score where photo_id in (select id from t_photo where trashed_at is null)) as scored", ("photo", "face", "tag", "score"))
def catalog_totals(spark, d):
    return reads.totals(frame(spark, d, "photo"), _people(spark, d), frame(spark, d, "tag"), _scores(spark, d))


@query("select id, path, row_number() over (order by role, path) as k from t_file where photo_id = 33", ("file",))
def files_of_photo(spark, d):
    f = frame(spark, d, "file").withColumn("content_hash", F.lit(None).cast("string"))
    rows = reads.files_for_photo(f, 33)
    return rows.select("id", "path", F.expr("row_number() over (order by role, path)").alias("k"))  # one photograph's files


@query("select id, case when id % 3 = 0 then 'new' when id % 2 = 0 then 'old' end as content_hash from t_file", ("file",))
def set_content_hash(spark, d):
    f = frame(spark, d, "file").withColumn("content_hash", F.when(F.col("id") % 2 == 0, "old"))
    return reads.set_content_hashes(f, f.where("id % 3 = 0").select("id", F.lit("new").alias("content_hash"))).select("id", "content_hash")


@query("+ s as (select distinct event_id * 3 as id from events), f as (select photo_id, count(*) as n, sum(size_bytes) as b from t_file group by 1) select coalesce(sum(n), 0)::bigint as files, coalesce(sum(b), 0)::bigint as bytes, count(*) filter (state in ('raw_only', 'raster_only')) as incomplete, count(*) filter (n is null) as missing from s left join t_photo using (id) left join f on f.photo_id = s.id", ("photo", "file"))
def delete_totals(spark, d):
    return reads.selection_totals(tables.delete_selection(_read(spark, d, "events").selectExpr("event_id * 3 as photo_id"), frame(spark, d, "photo"), frame(spark, d, "file")))


@query("select id, case when id in (select photo_id from t_file where id % 11 = 0) then null else trashed_at end as trashed_at from t_photo", ("photo", "file"))
def clear_trashed_for_paths(spark, d):
    f = frame(spark, d, "file")
    # paths repeat in the test data, so they are made distinct by id
    f = f.withColumn("path", F.concat("path", F.lit("#"), F.col("id").cast("string")))
    return tables.clear_trashed_for_paths(frame(spark, d, "photo"), f, f.where("id % 11 = 0").select("path")).select("id", "trashed_at")


# grid -------------------------------------------------------------------------------------------------------------


@query(_VIEW + " select id from v where id in (select photo_id from t_decision where rating = 3) and camera = 'BUILDING'", _IN_VIEW)
def narrowing_native(spark, d):
    return grid.narrow_native(_view(spark, d), grid.Filters("native", camera="BUILDING", folder="root/nowhere"), tag=frame(spark, d, "decision").where("rating = 3")).select("id")


@query("""+ p as (select dir, count(*) as k from t_photo where trashed_at is null group by dir), a as (select unnest(range(1, len(string_split(dir, '/')) + 1)) as i, dir, k from p), u as (select array_to_string(string_split(dir, '/')[1:i], '/') as path, dir, k from a)
select path, string_split(path, '/')[-1] as name, len(string_split(path, '/'))::int as depth, case when path like '%/%' then regexp_replace(path, '/[^/]+$', '') end as parent, coalesce(sum(k) filter (path = dir), 0)::bigint as direct, sum(k)::bigint as recursive from u group by path""", ("photo",))
def folder_tree(spark, d):
    return grid.folder_tree(grid.directories(frame(spark, d, "photo")))


# index, trash, caches ---------------------------------------------------------------------------------------------


@query("""+ o as (select id, dir, stem, trashed_at from t_photo where id % 4 != 0), g as (select distinct dir, stem, 'pair' as state from t_photo where id % 3 != 0),
n as (select g.dir, g.stem, o.id, row_number() over (partition by o.id is null order by g.dir, g.stem) as k from g left join o using (dir, stem)), l as (select max(id) as last from o),
f as (select coalesce(n.id, last + n.k) as id, dir, stem, null::bigint as trashed_at from n, l)
select * from f union all select id, dir, stem, trashed_at from o where id not in (select id from f) and trashed_at is not null""", ("photo",))
def index_photos(spark, d):
    p = frame(spark, d, "photo")
    old = p.where("id % 4 != 0").selectExpr("id", "1L as library_id", "dir", "stem", "state", "false as needs_review", "trashed_at")
    empty = F.array().cast("array<string>")
    groups = p.where("id % 3 != 0").select("dir", "stem").distinct().withColumns({"raws": F.array(F.concat_ws("/", "dir", F.concat("stem", F.lit(".cr3")))), "rasters": empty, "sidecars": empty, "videos": empty, "state": F.lit("pair"), "review": empty, "needs_review": F.lit(False)})
    meta = groups.select(F.get("raws", F.lit(0)).alias("path"), F.lit(1).cast("long").alias("size_bytes"), F.lit(2).cast("long").alias("mtime_ns"))
    files = spark.createDataFrame([], "id long, library_id long, photo_id long, path string, role string, size_bytes long, mtime_ns long, content_hash string, indexed_at long")
    new, _ = indexing.index_groups({"photo": old, "file": files}, groups, meta, 1, 9, cutter(spark))
    return new["photo"].select("id", "dir", "stem", "trashed_at")


@query("""+ m as (select l_orderkey as op, l_orderkey * 8 + l_linenumber as k, (l_quantity * 10)::bigint - 100 as size from lineitem where l_orderkey % 3 = 0)
select 'op' || op as op_id, (op % 97)::bigint as at, count(*) as files, sum(greatest(size, 0))::bigint as bytes, count(*) filter (k % 4 != 0) as present, count(*) filter (k % 4 != 0) < count(*) as incomplete from m group by op""", ("frames",))
def trash_rollup(spark, d):
    m = _read(spark, d, "lineitem").where("l_orderkey % 3 = 0").selectExpr("l_orderkey as op", "l_orderkey * 8 + l_linenumber as k", "cast(l_quantity * 10 as long) - 100 as size")
    file = F.struct(F.lit("s").alias("source"), F.concat(F.lit("t/"), F.col("k").cast("string")).alias("destination"), "size", F.lit(None).cast("string").alias("expected_hash"))
    log = m.groupBy("op").agg(F.collect_list(file).alias("files")).selectExpr("concat('op', cast(op as string)) as op_id", "cast(op % 97 as long) as at", "'trash' as action", "'' as reason", "files")
    return trash.rollup(log, m.where("k % 4 != 0").select(F.concat(F.lit("t/"), F.col("k").cast("string")).alias("path")))


def _cache(spark, d):
    name = F.when(F.col("id") % 5 == 0, F.concat(F.col("id").cast("string"), F.lit(".jpg"))).otherwise(F.concat(F.sha2(F.col("id").cast("string"), 256), F.lit(".jpg")))
    return frame(spark, d, "file").select(F.concat(F.lit("256/"), name).alias("path"), F.col("size_bytes").alias("size"), (F.col("id") * 7919 % 1000003).alias("mtime"), "id")


@query("select count(*) as files, sum(size_bytes)::bigint as bytes, 1000000::bigint as cap, round(sum(size_bytes) / 1000000.0, 6) as utilisation from t_file where id % 5 != 0", ("file",))
def cache_stats(spark, d):
    return thumbs.stats(_cache(spark, d), 1_000_000).withColumn("utilisation", F.round("utilisation", 6))


@query("select id from (select id, row_number() over (order by (id * 7919) % 1000003 desc, case when id % 5 = 0 then '256/' || id || '.jpg' else '256/' || sha256(id::varchar) || '.jpg' end) as k from t_file) where k > 100", ("file",))
def cache_trim(spark, d):
    return thumbs.trimmed(_cache(spark, d), 100).select("id")


# scalars and progress ---------------------------------------------------------------------------------------------


@query("select p_partkey, 'nvidia' as vendor, p_name as name, case when p_partkey % 3 != 0 then p_size::bigint * 1048576 end as vram_bytes, case when p_partkey % 2 = 0 then '551.1' end as driver from part")
def nvidia_report(spark, d):
    report = F.concat(F.lit("\n,12\nlone\n"), F.col("p_name"), F.lit(", "), F.when(F.col("p_partkey") % 3 != 0, F.col("p_size").cast("string")).otherwise("[N/A]"), F.when(F.col("p_partkey") % 2 == 0, ", 551.1").otherwise(","))
    return _read(spark, d, "part").select("p_partkey", F.explode(devices.nvidia_gpus(report)).alias("g")).select("p_partkey", "g.*")


@query("select p_partkey, k, case when k = 1 then 'amd' else 'apple' end as vendor, case when k = 1 then 'Radeon ' || p_size else 'Apple M1' end as name, case when k = 1 then p_size::bigint * 1073741824 end as vram_bytes from part, (values (1), (2)) x(k)")
def profiler_report(spark, d):
    report = F.concat(F.lit("Graphics:\n    VRAM (Total): 1 GB\n      Chipset Model: Radeon "), F.col("p_size").cast("string"), F.lit("\n      VRAM (Dynamic, Max): "), F.col("p_size").cast("string"), F.lit(" GB\n      Chipset Model: Apple M1\n      VRAM (Total): lots"))
    rows = _read(spark, d, "part").select("p_partkey", F.posexplode(devices.profiled_gpus(report)).alias("k", "g"))
    return rows.select("p_partkey", (F.col("k") + 1).alias("k"), "g.vendor", "g.name", "g.vram_bytes")


@query("select p_partkey, to_base64(encode(p_name)) as b from part")
def base64_names(spark, d):
    return _read(spark, d, "part").select("p_partkey", devices.base64_text(F.col("p_name").cast("binary")).alias("b"))


@query("select id, len(vector)::int as n, round(list_sum(vector::double[]), 5) as total from t_face", ("face",))
def vector_bytes(spark, d):
    back = media.decode_vector(F.concat(media.encode_vector(F.col("vector")), F.unhex(F.lit("0102"))))
    return frame(spark, d, "face").select("id", back.alias("v")).select("id", F.size("v").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("select event_id, max(event_id * 7 % 1000) over (partition by user_id order by ts, event_id * 7 % 1000 rows unbounded preceding) as highest from events")
def progress_high_water(spark, d):
    e = _read(spark, d, "events").selectExpr("event_id", "user_id", "ts", "event_id * 7 % 1000 as done")
    return progress.high_water(e, ["user_id"], "ts").select("event_id", "highest")


@query()
def clustering_sweep(spark, d):
    """Brute force in tests."""
    rows = vectors.synthetic(spark, 12, 9, 24, 0.25)
    return vectors.sweep(rows, [2, 8], cutter(spark))


@query("select o_orderkey, case when o_orderkey % 10 = 0 then 'unknown' else strftime(make_timestamp((o_orderkey * 7919 - 3000000) * 1000000), '%Y-%m-%d %H:%M UTC') end as t from orders")
def epoch_texts(spark, d):
    at = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderkey") * 7919 - 3_000_000)
    return _read(spark, d, "orders").select("o_orderkey", media.epoch_text(at).alias("t"))


@query("select photo_id, nullif(case photo_id % 3 when 0 then '' else camera end, '') as camera, case when photo_id % 4 != 0 then exposure_time end as exposure_time from t_shots", ("shots",))
def frame_shaping(spark, d):
    f = frame(spark, d, "shots").withColumns({"camera": F.when(F.col("photo_id") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "camera", F.lit("\t"))), "exposure_time": F.when(F.col("photo_id") % 4 == 0, -1.0).otherwise(F.col("exposure_time"))})
    return sessions.shaped(f).select("photo_id", "camera", "exposure_time")


@query("+ x as (select camera, captured_at // 3600 as h, count(*) as n from t_shots where captured_at is not null group by 1, 2) select count(*) as groups, count(*) filter (n > 1) as redundant, sum(n)::bigint as frames from x", ("shots",))
def redundant_groups(spark, d):
    f = frame(spark, d, "shots").where("captured_at is not null").withColumn("burst_id", F.xxhash64("camera", F.expr("captured_at div 3600")))
    return sessions.redundant(f).agg(F.count("*").alias("groups"), F.count_if("redundant").alias("redundant"), F.sum("size").alias("frames"))


@query("select id, row_number() over (order by confidence desc, id) as k from (select f.id, f.id * 37 % 101 / 1e0 as confidence from t_face f join t_file x on x.id = f.file_id where x.photo_id in (select min(x.photo_id) from t_face f join t_file x on x.id = f.file_id))", ("face", "file"))
def faces_by_confidence(spark, d):
    f = frame(spark, d, "face").select("id", "file_id", *(F.lit(0.0).alias(c) for c in ("x", "y", "width", "height")), (F.col("id") * 37 % 101 / 1.0).alias("confidence"))
    x = frame(spark, d, "file")
    one = f.join(x.select(F.col("id").alias("file_id"), "photo_id"), "file_id").agg(F.min("photo_id")).first()[0]
    return people.faces_for_photo(f, x, one).select("id", F.expr("row_number() over (order by confidence desc, id)").alias("k"))  # one photograph's faces


@query("select name, confidence, row_number() over (order by confidence desc, name) as k from (select lower(trim(name)) as name, max(confidence) as confidence from t_tag where photo_id = 7 group by 1)", ("tag",))
def tags_by_confidence(spark, d):
    t = tables.dedupe_tags(frame(spark, d, "tag")).withColumn("model", F.lit("m"))
    return reads.tags_for_photo(t, 7).select("name", "confidence", F.expr("row_number() over (order by confidence desc, name)").alias("k"))  # one photograph's tags


@query("+ t as (select distinct photo_id from t_tag where lower(trim(name)) = 'click') select id from t_photo where trashed_at is null and id in (select photo_id from t)", ("tag", "photo"))
def photos_with_tag(spark, d):
    t = frame(spark, d, "tag").withColumn("name", media.tag_name(F.col("name")))
    return reads.photos_with_tag(t, frame(spark, d, "photo"), "click")


@query("select id, dir, stem, state from t_photo where id % 5 = 0", ("photo",))
def photos_needing_review(spark, d):
    return reads.needing_review(frame(spark, d, "photo").withColumn("needs_review", F.col("id") % 5 == 0))
