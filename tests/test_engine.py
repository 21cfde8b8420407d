"""Small cases of the engine's operators with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fotolith.functions import imaging, media, paths
from fotolith.operators import grid, ranks, resolve, scoring, sessions, tables, vectors
from fotolith.plans.catalog import Catalog, TooNew, rescore
from fotolith.plans.checkpoint import cutter
from fotolith.sources import files as src
from fotolith.streaming import settle


def frames(spark, rows):
    full = [(i, d, c, t, *([float(i)] * 8)) for i, d, c, t in rows]
    return spark.createDataFrame(full, "photo_id long, dir string, camera string, captured_at long, " + ", ".join(f"m{i} double" for i in range(8)))


def test_shoots_split_after_the_gap_only(spark):
    rows = [(1, "a", "x", 0), (2, "a", "x", 1800), (3, "a", "x", 3601), (4, "a", "y", 1801), (5, "a", "x", None), (6, "a", None, 5), (7, "a", "x", None)]
    got = {r.photo_id: (r.shoot_id, r.shoot_size, r.time_clustered) for r in sessions.shoots(frames(spark, rows)).collect()}
    assert got == {6: (0, 1, True), 1: (1, 2, True), 2: (1, 2, True), 3: (2, 1, True), 5: (3, 2, False), 7: (3, 2, False), 4: (4, 1, True)}
    again = {r.photo_id: r.shoot_id for r in sessions.shoots(frames(spark, rows[::-1])).collect()}
    assert again == {k: v[0] for k, v in got.items()}


def test_mid_ranks(spark):
    v = [0, 0, 1, 2, 2, 2, 5]
    df = spark.createDataFrame([(i, "g", float(x)) for i, x in enumerate(v)] + [(9, "h", 3.0), (10, "h2", None)], "id int, g string, v double")
    want = [14.2857, 14.2857, 35.7143, 64.2857, 64.2857, 64.2857, 92.8571]
    a = {r.id: r.r for r in df.select("id", ranks.mid_rank(["g"], "v").alias("r")).collect()}
    b = {r.id: r.r for r in ranks.library_mid_rank(df, ["g"], "v", "r").collect()}
    for got in (a, b):
        assert [round(got[i], 4) for i in range(7)] == want
        assert got[9] == 50 and got[10] is None


def test_bands_and_ordinals(spark):
    df = spark.createDataFrame([(70.0,), (69.999,), (35.0,), (34.999,), (None,)], "c double").select(media.band(F.col("c")).alias("b"))
    assert [r.b for r in df.collect()] == ["keep", "review", "review", "reject", None]
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (11.0,), (12.0,), (21.0,), (92.5,), (113.0,)], "v double").select(media.ordinal(F.col("v")).alias("o"))
    assert [r.o for r in df.collect()] == ["1st", "2nd", "3rd", "11th", "12th", "21st", "93rd", "113th"]


@pytest.mark.parametrize(
    "times, isos, want",
    [
        ([1 / 500, 1 / 250, 1 / 125], [100] * 3, True),
        ([1 / 500, 1 / 300, 1 / 125], [100] * 3, False),
        ([1 / 500, 1 / 250, 1 / 125], [100, 200, 100], False),
        ([1 / 500, 1 / 250], [100] * 2, False),
        ([1 / 500, 1 / 500, 1 / 250], [100] * 3, False),
    ],
)
def test_brackets(spark, times, isos, want):
    df = spark.createDataFrame([(0, t, i) for t, i in zip(times, isos)], "burst_id long, exposure_time double, iso int")
    assert sessions.brackets(df).first().is_bracket is want


def test_keepers(spark):
    b = spark.createDataFrame([(i, 0, 1.0, 100) for i in range(1, 7)], "photo_id long, burst_id long, exposure_time double, iso int")
    scores = spark.createDataFrame([(1, 10.0), (2, 90.0), (3, 50.0), (4, 70.0)], "photo_id long, score double")
    none = spark.createDataFrame([], "photo_id long")
    kept = {r.photo_id for r in sessions.keepers(b, scores, none).where("keep").collect()}
    assert kept == {2, 4}
    three = spark.createDataFrame([(5,), (6,), (1,)], "photo_id long")
    assert {r.photo_id for r in sessions.keepers(b, scores, three).where("keep").collect()} == {5, 6, 1}


def test_bursts_split_on_the_picture_before(spark):
    rows = [(1, "c", 0, 0), (2, "c", 1, None), (3, "c", 2, (1 << 20) - 1), (4, "c", 3, 0), (5, "c", 9, 0), (6, "d", 0, 0), (7, "d", None, 0)]
    df = spark.createDataFrame(rows, "photo_id long, camera string, captured_at long, hash long")
    got = {r.photo_id: r.burst_id for r in sessions.bursts(df).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 1, 5: 2, 6: 3}


def test_duplicate_markers_and_paths(spark):
    names = ["x (1)", "x copy", "x copy 2", "x-copy", "x-1", "x (a)", "IMG (2) (3)"]
    df = spark.createDataFrame([(n,) for n in names], "s string").select(paths.duplicate_base(F.col("s")).alias("b"))
    assert [r.b for r in df.collect()] == ["x", "x", "x", "x", None, None, "IMG (2)"]
    p = ["a/IMG.CR3.xmp", "a/b.JPG", "noext", "a/.hidden", "x/a.tar.mp4"]
    df = spark.createDataFrame([(n,) for n in p], "p string")
    got = df.select(paths.kind(F.col("p")).alias("k"), paths.stem(F.col("p")).alias("s"), paths.directory(F.col("p")).alias("d")).collect()
    assert [tuple(r) for r in got] == [("sidecar", "IMG", "a"), ("raster", "b", "a"), ("other", "noext", ""), ("other", ".hidden", "a"), ("video", "a.tar", "x")]


def test_grouping(spark):
    tree = ["shoot_a/IMG_0001.CR3", "shoot_a/IMG_0001.JPG", "shoot_a/IMG_0001.XMP", "shoot_a/IMG_0003.CR3", "shoot_a/IMG_0005.CR3", "shoot_a/IMG_0005.NEF", "shoot_a/IMG_0005.JPG", "shoot_a/IMG_0006.CR3", "shoot_a/IMG_0006.JPG", "shoot_a/IMG_0006 (1).CR3", "shoot_b/IMG_0001.CR3", "shoot_b/café.JPG", "shoot_b/café.CR3", "shoot_a/notes.txt", "shoot_a/only.xmp", "s/raw/q.CR3", "s/jpg/q.JPG"]
    df = spark.createDataFrame([(p,) for p in tree], "path string")
    got = {(r.dir, r.stem): (r.state, list(r.review)) for r in resolve.group_files(df).collect()}
    assert got == {
        ("shoot_a", "img_0001"): ("pair", []),
        ("shoot_a", "img_0003"): ("raw_only", []),
        ("shoot_a", "img_0005"): ("ambiguous", ["multiple_raw"]),
        ("shoot_a", "img_0006"): ("pair", []),
        ("shoot_a", "img_0006 (1)"): ("raw_only", ["possible_duplicate_import"]),
        ("shoot_b", "img_0001"): ("raw_only", []),
        ("shoot_b", "café"): ("pair", []),
        ("s/raw", "q"): ("pair", []),
    }


def test_exif_times(spark):
    rows = ["2026:10:04 12:30:15", "2026-10-04T12:30:15.99+02:00", "2026:10:04", "0000:01:01 00:00:00", "2026:13:01 00:00:00", "2026:02:31 00:00:00", "rubbish", None, "2026:10:04 25:00:00"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, t string").select("i", media.exif_time(F.col("t")).alias("s"))
    got = {r.i: r.s for r in df.collect()}
    assert got[0] == 1791117015 and got[1] == 1791117015 and got[2] == 1791117015 - 45015
    assert got[3] is None and got[4] is None and got[6] is None and got[7] is None and got[8] is None
    assert got[5] == 1772496000  # 3 March


def test_camera_names(spark):
    rows = [("Canon", "Canon EOS R5"), ("Nikon Corp", "NIKON Z 9"), ("Sony", "A7"), ("", "X"), ("Y ", None), (None, None), ("A b", "another")]
    df = spark.createDataFrame(rows, "make string, model string").select(media.camera_name(F.col("make"), F.col("model")).alias("c"))
    assert [r.c for r in df.collect()] == ["Canon EOS R5", "NIKON Z 9", "Sony A7", "X", "Y", None, "A b another"]


def test_explanations(spark):
    rows = frames(spark, [(i, "a", "x", i) for i in range(10)])
    got = {r.photo_id: r.lines for r in scoring.explain(scoring.score(scoring.normalise(rows))).collect()}
    assert got[9][0] == "Review — 64/100 (Balanced, ranked of 10 in this shoot)"
    assert any(x.startswith("  + focus excellent (95th percentile of 10") for x in got[9])
    few = scoring.explain(scoring.score(scoring.normalise(frames(spark, [(1, "a", "x", 1)])))).first().lines
    assert few[0].endswith("ranked across the library; this shoot has only 1 frames)")
    bad = scoring.score(scoring.normalise(rows), (0, 0, 0, 0, 0)).first()
    assert bad.composite == 0 and bad.band == "review" and not bad.terms


def brute_whispers(n, edges, rounds=20):
    near = {i: [] for i in range(n)}
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    label = list(range(n))
    for _ in range(rounds):
        changed = False
        for i in range(n):
            if near[i]:
                votes = {}
                for j, w in near[i]:
                    votes[label[j]] = votes.get(label[j], 0) + w
                top = max(votes.values())
                best = min(k for k, v in votes.items() if v == top)
                changed |= best != label[i]
                label[i] = best
        if not changed:
            break
    groups = {}
    for i, x in enumerate(label):
        groups.setdefault(x, []).append(i)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def test_clusters_equal_the_sequential_definition(spark):
    rng = np.random.default_rng(3)
    edges = sorted({(int(min(a, b)), int(max(a, b)), float(w)) for a, b, w in zip(rng.integers(0, 60, 70), rng.integers(0, 60, 70), rng.integers(3, 9, 70) / 8) if a != b})
    edges = list({(a, b): (a, b, w) for a, b, w in edges}.values())
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    got = {}
    for r in vectors.clusters(df, lambda x: x.checkpoint()).collect():
        got.setdefault(r.cluster, set()).add(r.id)
    ordered = sorted(edges, key=lambda e: (e[0], -e[2], e[1]))
    assert {frozenset(g) for g in got.values()} == brute_whispers(60, ordered)


def test_pair_metrics_without_pairs(spark):
    r = vectors.pair_metrics(spark.createDataFrame([(1, None), (2, None)], "label int, cluster int")).first()
    assert (r.tp, r.fp, r.precision, r.recall, r.f1) == (0, 0, 0, 0, 0)


def test_measurements():
    rng = np.random.default_rng(0)
    sharp = (rng.random((120, 160)) > 0.5).astype(np.float32) * 200
    sharp = np.kron(sharp[::8, ::8], np.ones((8, 8), np.float32))
    k = np.ones((5, 5)) / 25
    pad = np.pad(sharp, 2, mode="edge")
    soft = sum(pad[i : i + sharp.shape[0], j : j + sharp.shape[1]] * k[i, j] for i in range(5) for j in range(5)).astype(np.float32)
    assert imaging.focus(sharp)["focus"] > imaging.focus(soft)["focus"]
    assert imaging.difference_hash(sharp) == imaging.difference_hash(sharp * 0.5)
    white = np.full((64, 64), 255, np.float32)
    e = imaging.exposure(white, imaging.full(white))
    assert e["clipped_high"] == 1 and e["clipped_low"] == 0 and e["range"] < 0.01
    noisy = 128 + rng.normal(0, 5, (200, 200)).astype(np.float32)
    assert abs(imaging.noise_sigma(noisy, imaging.full(noisy)) - 5) < 0.3
    stripes = np.tile((np.arange(160) // 4 % 2 * 200).astype(np.float32), (120, 1)) + rng.normal(0, 1, (120, 160)).astype(np.float32)
    assert imaging.focus(stripes)["anisotropy"] > 10
    points = imaging.FACE_TEMPLATE * 2 + [10, 20]
    m = imaging.similarity_transform(points)
    assert np.allclose(points @ m[:, :2].T + m[:, 2], imaging.FACE_TEMPLATE)


def test_measured_udf(spark):
    df = spark.createDataFrame([(4, 4, bytearray(16)), (4, 4, bytearray(3)), (40, 30, bytearray(range(240)) * 5)], "w int, h int, p binary")
    rows = df.select(imaging.measured("w", "h", "p").alias("m")).collect()
    assert rows[1].m.m0 is None and rows[2].m.hash is not None


def test_sidecars(spark):
    text = '<x:xmpmeta><rdf:RDF><rdf:Description xmp:Rating="3" my:Rating="9" xmp:Label="Red"><dc:subject><rdf:Bag><rdf:li>sea</rdf:li><rdf:li> sky </rdf:li></rdf:Bag></dc:subject></rdf:Description></rdf:RDF></x:xmpmeta>'
    df = spark.createDataFrame([(text, 5, "A & b"), (text, 1, None), ("", 2, "x"), ('<r xmp:Rating="9">', 0, None)], "t string, r int, l string")
    got = df.select(src.parse_sidecar(F.col("t")).alias("s"), src.merge_sidecar(F.col("t"), F.col("r"), F.col("l")).alias("m")).collect()
    assert (got[0].s.rating, got[0].s.label, got[0].s.keywords) == (3, "Red", ["sea", "sky"])
    assert got[3].s.rating is None
    assert 'xmp:Rating="5"' in got[0].m and 'my:Rating="9"' in got[0].m and 'xmp:Label="A &amp; b"' in got[0].m
    assert "xmp:Label" not in got[1].m and "<rdf:li>sea</rdf:li>" in got[1].m
    assert 'xmp:Rating="2"' in got[2].m and 'xmp:Label="x"' in got[2].m


def test_exif_and_previews():
    import struct

    ifd = struct.pack("<H", 2) + struct.pack("<HHII", 0x0110, 2, 6, 50) + struct.pack("<HHIHH", 0x829A, 3, 2, 1, 500) + struct.pack("<I", 0)
    tiff = (b"II*\0" + struct.pack("<I", 8) + ifd).ljust(50, b"\0") + b"EOS R\0"
    assert src.tiff_fields(tiff) == {"model": "EOS R", "exposure_time": 1 / 500}
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", 8 + len(tiff)) + b"Exif\0\0" + tiff + b"\xff\xd9"
    assert src.metadata_block(jpeg)[:2] == b"II"
    small = b"\xff\xd8\xff\xc0" + struct.pack(">HBHH", 11, 8, 600, 800) + b"\0" * 4 + b"\xff\xda\0\x02" + b"\0" * 20 + b"\xff\xd9"
    assert [p[2:] for p in src.previews(b"zz" + small + b"yy" + small[:-2] + b"123\xff\xd9")] == [(800, 600), (800, 600)]
    assert src.tiff_fields(b"rubbish") == {} and src.cr3_fields(b"\0" * 40) == {}


def test_scan_and_manifest(spark, tmp_path):
    for p in ("a/IMG.CR3", "a/._IMG.CR3", ".git/x.jpg", "a/zero.jpg", "a/notes.txt"):
        (tmp_path / p).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / p).write_bytes(b"" if "zero" in p else b"data")
    good, empty = src.scan(spark, str(tmp_path))
    assert [r.path.rsplit("/", 1)[1] for r in good.collect()] == ["IMG.CR3"]
    assert [r.path.rsplit("/", 1)[1] for r in empty.collect()] == ["zero.jpg"]
    log = tmp_path / "log.jsonl"
    log.write_text('{"op_id":"1","at":5,"action":"trash","reason":"r","files":[{"source":"a","destination":"b","size":7}]}\n\n')
    assert tables.operations(src.read_manifest(spark, str(log))).first().bytes == 7
    log.write_text("{broken\n")
    with pytest.raises(Exception):
        src.read_manifest(spark, str(log)).collect()


def test_vocabulary():
    v = np.eye(3, dtype=np.float32)
    data = src.vocabulary_bytes(v)
    assert src.parse_vocabulary(data, ["a", "b", "c"])[1] == ("b", [0.0, 1.0, 0.0])
    for bad in (b"x" + data[1:], data + b"1"):
        with pytest.raises(ValueError):
            src.parse_vocabulary(bad, ["a", "b", "c"])


def test_catalog(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "cat"))
    assert c.table("photo").isEmpty()
    c.replace(photo=spark.createDataFrame([(i, "d") for i in range(1, 11)], "id long, dir string"), measurement=frames(spark, [(i, "x", "cam", i) for i in range(1, 11)]).drop("dir").withColumn("scorer_version", F.lit("v")))
    rescore(c, "v", 1)
    assert c.table("score").where("metric = 'composite'").count() == 10
    c.upsert("setting", spark.createDataFrame([("a", "1", 0)], "key string, value string, updated_at long"))
    c.upsert("setting", spark.createDataFrame([("a", "2", 0), ("b", "3", 0)], "key string, value string, updated_at long"))
    assert {(r.key, r.value) for r in c.table("setting").collect()} == {("a", "2"), ("b", "3")}
    state = c._read()
    c._write(state | {"version": 99})
    with pytest.raises(TooNew):
        Catalog(spark, str(tmp_path / "cat"))


def test_people(spark):
    m = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "person_id long, face_id long")
    assert tables.merge_people(m, 1, 1)[0].count() == 3
    people = spark.createDataFrame([(1, "A", True), (2, None, False)], "id long, name string, confirmed boolean")
    more = people.selectExpr("*", "0L as created_at", "0L as updated_at")
    for faces in ([(1,), (2,)], [(9,)]):  # all, none
        who, which = tables.split_person(more, m, 1, spark.createDataFrame(faces, "face_id long"), 9)
        assert who.count() == 2 and {tuple(r) for r in which.collect()} == {(1, 1), (1, 2), (2, 3)}
    who, which = tables.split_person(more, m, 1, spark.createDataFrame([(2,)], "face_id long"), 9)
    assert {(r.id, r.name, r.confirmed) for r in who.collect()} == {(1, "A", True), (2, None, False), (3, None, True)}
    assert {tuple(r) for r in which.collect()} == {(1, 1), (3, 2), (2, 3)}
    clusters = spark.createDataFrame([(1, 1, 2), (5, 1, 2), (6, 6, 3), (7, 6, 3), (8, 6, 3)], "id long, cluster long, size long")
    p, f = tables.replace_people(people, m, clusters, cutter(spark))
    assert {(r.id, r.confirmed) for r in p.collect()} == {(1, True), (3, False), (4, False)}
    assert {(r.person_id, r.face_id) for r in f.collect()} == {(1, 1), (1, 2), (3, 6), (3, 7), (3, 8), (4, 5)}


def test_filters_differ_by_dialect(spark):
    df = spark.createDataFrame([(1, None, "Été_1"), (2, "review", "x")], "id long, band string, stem string")
    assert df.where(grid.Filters("web", band="review").predicate()).count() == 2
    assert df.where(grid.Filters("native", band="review").predicate()).count() == 1
    assert df.where(grid.Filters("native", search="ete").predicate()).count() == 1
    assert df.where(grid.Filters("web", search="ete").predicate()).count() == 0
    assert not grid.Filters("web", search=" ").active()


def test_destinations_and_plan(spark):
    m = spark.createDataFrame([("a", "t/x.cr3"), ("b", "t/x.cr3"), ("c", "t/y")], "source string, destination string")
    assert {r.source: r.destination for r in tables.destinations(m).collect()} == {"a": "t/x.cr3", "b": "t/x~2.cr3", "c": "t/y"}
    plan = spark.createDataFrame([("p", "1"), ("q", "2"), ("r", "3")], "path string, content_hash string")
    now = spark.createDataFrame([("p", "1"), ("q", "9"), ("s", "4")], "path string, content_hash string")
    assert {(r.path, r.problem) for r in tables.changed_since_plan(plan, now, 10, 0).collect()} == {("q", "changed"), ("r", "vanished"), ("s", "appeared")}
    assert tables.changed_since_plan(plan, now, 9999, 0).count() == 3


def test_settled_stream(spark, tmp_path):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    rows = [("/lib/a.jpg", "create", t0), ("/lib/a.jpg", "remove", t0 + dt.timedelta(seconds=2)), ("/lib/.git/b.jpg", "create", t0), ("/other/c.jpg", "create", t0), ("/lib/z.jpg", "modify", t0 + dt.timedelta(seconds=60))]
    src_dir = str(tmp_path / "in")
    spark.createDataFrame(rows, "path string, kind string, ts timestamp").coalesce(1).write.parquet(src_dir)
    more = [("/lib/z.jpg", "modify", t0 + dt.timedelta(seconds=600))]
    events = spark.readStream.schema("path string, kind string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(src_dir)
    seen = []
    q = settle.start(settle.watch(events, "/lib"), lambda a, v: seen.append(([r.path for r in a.collect()], [r.path for r in v.collect()])), str(tmp_path / "ck"))
    q.processAllAvailable()
    spark.createDataFrame(more, "path string, kind string, ts timestamp").coalesce(1).write.mode("append").parquet(src_dir)
    q.processAllAvailable()
    q.processAllAvailable()
    assert settle.status(q)["running"]
    q.stop()
    gone = [p for _, v in seen for p in v]
    assert gone == ["/lib/a.jpg"]
