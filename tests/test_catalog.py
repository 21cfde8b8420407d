"""Catalog changes, passes, trash, library and streams against brute force and known answers."""

import json
import random
import re
import struct
import threading
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fotolith.__main__ import run
from fotolith.operators import decisions, grid, numbering, passes, people, ranks, tables, trash, vectors
from fotolith.plans.catalog import Catalog
from fotolith.plans.checkpoint import cutter
from fotolith.plans.library import Library
from fotolith.plans.queries import QUERIES
from fotolith.sources import files, thumbs
from fotolith.streaming import progress, settle


def in_turn(doomed, heirs):
    out, taken = set(), set()
    for photo, size, mtime in sorted(doomed):
        fits = sorted({(0 if role == "raw" else 1, h) for h, role, s, m in heirs if (s, m) == (size, mtime) and role in ("raw", "raster") and h not in taken})
        if fits:
            taken.add(fits[0][1])
            out.add((photo, fits[0][1]))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_adoption_is_in_turn(spark, seed):
    rng = random.Random(seed)
    doomed = [(i, rng.randint(1, 4), rng.randint(1, 2)) for i in range(25)]
    heirs = [(100 + rng.randint(0, 14), rng.choice(["raw", "raster", "sidecar"]), rng.randint(1, 4), rng.randint(1, 2)) for _ in range(40)]
    d = spark.createDataFrame(doomed, "photo_id long, source_size long, source_mtime long")
    h = spark.createDataFrame(heirs, "photo_id long, role string, size_bytes long, mtime_ns long")
    assert {tuple(r) for r in decisions.adopt(d, h, cutter(spark)).collect()} == in_turn(doomed, heirs)
    # a raw of (10, 100) and a rendering of (20, 200) are one heir
    one = decisions.adopt(spark.createDataFrame([(1, 10, 100), (2, 20, 200)], d.schema), spark.createDataFrame([(9, "raw", 10, 100), (9, "raster", 20, 200)], h.schema), cutter(spark))
    assert [tuple(r) for r in one.collect()] == [(1, 9)]


@pytest.mark.parametrize("seed", range(3))
def test_adoption_in_rounds_is_in_turn(spark, seed):
    rng = random.Random(seed)
    doomed = [(i, rng.randint(1, 6), 1) for i in range(300)]
    heirs = [(1000 + rng.randint(0, 199), rng.choice(["raw", "raster"]), rng.randint(1, 6), 1) for _ in range(500)]
    d = spark.createDataFrame(doomed, "photo_id long, source_size long, source_mtime long")
    h = spark.createDataFrame(heirs, "photo_id long, role string, size_bytes long, mtime_ns long")
    assert {tuple(r) for r in decisions.adopt(d, h, cutter(spark), in_turn=0).collect()} == in_turn(doomed, heirs)


def test_adoption_in_turn_reads_each_list_once():
    n = 60_000
    rows = pd.concat([pd.DataFrame({"s": 1, "m": 1, "id": range(n), "rank": -1}), pd.DataFrame({"s": 1, "m": 1, "id": range(n, 2 * n), "rank": 0})])
    began = time.process_time()
    out = decisions._in_turn(rows)
    assert time.process_time() - began < 10
    assert (out["heir_id"] == out["photo_id"] + n).all() and len(out) == n


def test_numbers_and_places(spark):
    rng = random.Random(1)
    values = [rng.choice([0.0, -1.5, 1e300, 1e-12, -7.0, 3.25, float(rng.randint(-50, 50))]) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(values)), "id long, x double").repartition(5)
    got = {r.id: r.n for r in numbering.numbered(df, ["x", F.desc("id")], cutter(spark)).collect()}
    want = {i: k + 1 for k, (_, i) in enumerate(sorted((x, -i) for i, x in enumerate(values)))}
    assert got == {-i: k for i, k in want.items()}
    below = {r.x: (r.below, r.ties, r.n) for r in ranks.places(df, [], "x").collect()}
    assert below == {v: (sum(w < v for w in values), values.count(v), len(values)) for v in set(values)}
    assert numbering.numbered(df.where("false"), ["x"], cutter(spark)).count() == 0


def test_ranges_by_sort_keys(spark):
    view = spark.createDataFrame([(1, "a", "x", 5), (2, "a", "y", None), (3, "b", "x", 5), (4, "b", "z", 9), (5, "c", "x", None)], "id long, dir string, stem string, captured_at long")
    for by in ("ranked", "name", "name_desc", "newest", "oldest"):
        order = [r.id for r in grid.sort(view, by).collect()]
        for a in range(1, 6):
            for b in (2, 4, 5):
                i, j = sorted((order.index(a), order.index(b)))
                assert {r.id for r in grid.select_range(view, by, a, b).collect()} == set(order[i : j + 1]), (by, a, b)
        assert grid.select_range(view, by, 1, 77).count() == 0
    assert [r.id for r in grid.selected(view, spark.createDataFrame([(4,), (2,), (8,)], "id long"), "newest").collect()] == [4, 2]
    tag, person = (spark.createDataFrame([(i,)], "photo_id long") for i in (3, 4))
    assert [r.id for r in grid.narrow_native(view, grid.Filters("native", folder="a"), tag=tag).collect()] == [3]
    with pytest.raises(ValueError):
        grid.narrow_native(view, grid.Filters("native"), tag=tag, person=person)


def test_folder_tree_sorts_numbers_by_value(spark):
    photos = spark.createDataFrame([(1, "/r/b 10", None), (2, "/r/b 2", None), (3, "/r/b 2/x", None), (4, "/r/a", 5)], "id long, dir string, trashed_at long")
    rows = grid.folder_tree(grid.directories(photos)).collect()
    assert [(r.path, r.direct, r.recursive) for r in rows] == [("/", 0, 0), ("/r", 0, 3), ("/r/b 2", 1, 2), ("/r/b 2/x", 1, 1), ("/r/b 10", 1, 1)]
    assert [r.parent for r in rows][1:] == [None, "/r", "/r/b 2", "/r"]


# trash ------------------------------------------------------------------------------------------------------------


@pytest.fixture()
def library(tmp_path):
    root = tmp_path / "lib"
    (root / "a").mkdir(parents=True)
    for n in ("a/x.cr3", "a/x.jpg", "a/y.cr3"):
        (root / n).write_bytes(n.encode())
    return root


def test_trash(spark, library):
    t = trash.Trash(library)
    names = [str(library / n) for n in ("a/x.cr3", "a/x.jpg")]
    hashes = {n: trash.file_hash(n) for n in names}
    plan = t.plan([*names, str(library / "a/none.cr3")], hashes, 1_700_000_000)
    assert plan.op_id == "2023-11-14-000000" and len(plan.moves) == 2 and len(plan.warnings) == 1
    assert {r.path: r.content_hash for r in trash.hashes_of(spark, spark.createDataFrame([(n,) for n in names], "path string")).collect()} == hashes
    assert t.commit(plan, "culled", 5) == 2 and not (library / "a/x.jpg").exists()
    # the same name again, and a changed file
    (library / "a/x.jpg").write_bytes(b"new")
    again = t.plan([names[1]], {names[1]: trash.file_hash(names[1])}, 1_700_000_007)
    assert again.moves[0].destination.endswith("/2023-11-14/a/x~2.jpg")
    (library / "a/x.jpg").write_bytes(b"other")
    with pytest.raises(trash.Changed):
        t.commit(again, "", 6)
    assert len(t.entries()) == 1
    report = t.restore(plan.op_id)
    assert (report["restored"], report["already_present"]) == (1, 0) and report["missing"] == [names[1]]
    assert trash.rollup(t.manifest(spark), spark.createDataFrame([(plan.moves[1].destination,)], "path string")).first().asDict() == {"op_id": plan.op_id, "at": 5, "files": 2, "bytes": 14, "present": 1, "incomplete": True}
    assert t.purge([plan.op_id]) == {"operations": 1, "removed": 1, "bytes": 7}
    assert [e["action"] for e in t.entries()] == ["trash", "purge"]
    with pytest.raises(KeyError):
        t.restore("nothing")
    with open(t.log, "a") as f:
        f.write("\nnot json\n")
    with pytest.raises(ValueError, match="line 4"):
        t.entries()


def test_trash_gates(spark, library, tmp_path):
    t = trash.Trash(library)
    (tmp_path / "out.jpg").write_bytes(b"1")
    (library / "link.jpg").symlink_to(tmp_path / "out.jpg")
    for bad in ("/", tmp_path / "out.jpg", library / "link.jpg", tmp_path / "gone.jpg"):
        with pytest.raises(trash.Refused):
            t.check(bad)
    (library / trash.EDITOR_LOCKS[0]).write_bytes(b"")
    with pytest.raises(trash.Refused, match="editor"):
        trash.Trash(library)
    (library / trash.EDITOR_LOCKS[0]).unlink()
    (library / "DCIM").mkdir()
    (library / "MISC").mkdir()
    with pytest.raises(trash.Refused, match="card"):
        trash.Trash(library)
    assert files.read_manifest(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_delete_session(library):
    photos = {1: [str(library / "a/x.cr3"), str(library / "a/x.jpg")], 2: [str(library / "a/y.cr3")], 3: []}
    s = trash.DeleteSession(library, lambda ids: {i: photos[i] for i in ids})
    with pytest.raises(trash.Refused, match="nothing"):
        s.commit(0)
    s.plan([1, 3], 100)
    assert s.pending
    photos[1].append(str(library / "a/y.cr3"))
    with pytest.raises(trash.Refused, match="appeared"):
        s.commit(101)
    photos[1].pop()
    s.plan([1, 3], 100)
    with pytest.raises(trash.Refused, match="expired"):
        s.commit(100 + trash.TTL_SECONDS + 1)
    s.plan([1, 3], 100)
    plan, gone = s.commit(101)
    assert (len(plan.moves), gone, s.pending) == (2, [1], False)


# files ------------------------------------------------------------------------------------------------------------


def jpeg(w, h, inside=b"", scan=b"\x12\xff\x00\x34\xff\xd0\x56"):
    app = b"\xff\xe1" + struct.pack(">H", 2 + len(inside)) + inside
    frame = b"\xff\xc0" + struct.pack(">HBHHB", 8, 8, h, w, 0)
    return b"\xff\xd8" + app + b"\xff\xff" + frame + b"\xff\xda" + struct.pack(">H", 2) + scan + b"\xff\xd9"


def test_previews_walk_to_the_true_end():
    thumb = jpeg(600, 400)
    outer = jpeg(2000, 1000, thumb)
    data = b"raw" + outer + b"--" + jpeg(800, 600) + jpeg(100, 80) + b"\xff\xd8\xff\xe1"
    found = files.previews(data)
    assert [(w, h) for _, _, w, h in found] == [(2000, 1000), (800, 600)]
    assert found[0][:2] == (3, 3 + len(outer))
    with pytest.raises(files.TooLarge):
        files.previews(data, most=10)
    assert files.decode_source(data, lambda x: x if len(x) == len(jpeg(800, 600)) else None) == jpeg(800, 600)
    assert files.decode_source(b"zz", lambda x: None, lambda x: "raw") == "raw"


def pgm(seed, w=96, h=64):
    x = np.random.default_rng(seed).integers(0, 255, (h, w)).astype(np.uint8)
    return b"P5\n%d %d\n255\n" % (w, h) + x.tobytes()


def test_library_from_scan_to_scores(spark, tmp_path):
    root = tmp_path / "lib"
    (root / "s" / ".git").mkdir(parents=True)
    for i in range(10):
        (root / "s" / f"img_{i}.jpg").write_bytes(pgm(i))
    (root / "s" / "img_0.cr3").write_bytes(b"raw")
    (root / "s" / "empty.jpg").write_bytes(b"")
    (root / "s" / ".git" / "x.jpg").write_bytes(b"1")
    args = [str(tmp_path / "cat"), str(root)]
    first = run(spark, [*args, "index"], now=100)
    assert (first["photos"], first["pairs"], first["files"], first["empty"], first["reused"], first["problems"]) == (10, 1, 11, 1, 0, [])
    catalog = Catalog(spark, args[0])
    lib = Library(catalog, str(root))
    assert catalog.table("score").where("metric = 'composite'").count() == 10
    photo = {r.stem: r.id for r in catalog.table("photo").collect()}
    # rate, rename, index again: the decision follows the file, nothing is measured twice but the renamed one
    new = spark.createDataFrame([(photo["img_3"], 4, False), (photo["img_0"], 0, True)], "photo_id long, rating int, rejected boolean")
    catalog.replace(decision=decisions.set_decisions(catalog.table("decision"), catalog.table("file"), new, 101)[0])
    (root / "s" / "img_3.jpg").rename(root / "s" / "moved.jpg")
    second = run(spark, [*args, "index"], now=200)
    assert (second["removed_photos"], second["removed_files"], second["adopted_decisions"], second["reused"], second["problems"]) == (1, 1, 1, 9, [])
    after = {r.stem: r.id for r in catalog.table("photo").collect()}
    assert "img_3" not in after and {n: i for n, i in photo.items() if n != "img_3"}.items() <= after.items()
    assert {(r.photo_id, r.rating, r.rejected) for r in catalog.table("decision").collect()} == {(after["moved"], 4, False), (photo["img_0"], 0, True)}
    detail = lib.detail(photo["img_0"]).first()
    assert [f.name for f in detail.files] == ["img_0.jpg", "img_0.cr3"] and detail.rejected and len(detail.terms) == 5
    assert run(spark, [*args, "stats"], now=201) == {"photos": 10, "folders": 1, "groups": 0, "named": 0, "tags": 0, "scored": 10}
    # sidecars: one is written beside the file, an unrated rejection has rating 0
    assert {(r.status, r.n) for r in lib.write_sidecars().collect()} == {("written", 2), ("skipped", 8)}
    assert 'xmp:Rating="4"' in (root / "s" / "moved.xmp").read_text()
    assert run(spark, [*args, "index", "--rescore"], now=300)["reused"] == 0


def test_walk_names_what_cannot_be_read(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"1")
    (tmp_path / "dir").mkdir()
    (tmp_path / "loop").symlink_to(tmp_path)
    good, empty, bad = files.walk(spark, str(tmp_path), cutter(spark))
    assert ([r.path for r in good.collect()], empty.count(), bad.count()) == ([str(tmp_path / "a.jpg")], 0, 0)
    _, _, bad = files.walk(spark, str(tmp_path / "nowhere"), cutter(spark))
    assert bad.count() == 1


def test_thumbnails(spark, tmp_path):
    root = str(tmp_path / "cache")
    rows = spark.createDataFrame([("p", bytearray(b"one")), ("q", bytearray(b"two")), ("r", bytearray(b"one"))], "path string, content binary").coalesce(1)
    made = thumbs.fill(rows, root, "grid", lambda content, edge: None if content == b"two" else content + str(edge).encode())
    assert {(r.path, r.status) for r in made.collect()} == {("p", "made"), ("q", "unreadable"), ("r", "kept")}
    assert thumbs.get(root, b"one", "grid") == b"one256" and thumbs.get(root, b"two", "grid") is None
    (tmp_path / "cache" / "stray.jpg").write_bytes(b"mine")
    have = thumbs.entries(spark, root)
    assert thumbs.stats(have, 12).first().asDict() == {"files": 1, "bytes": 6, "cap": 12, "utilisation": 0.5}
    assert thumbs.delete(thumbs.trimmed(have, 0)) == 1 and (tmp_path / "cache" / "stray.jpg").exists()


def test_trimming_keeps_exactly_so_many(spark):
    old = [("a", 1, 5), ("b", 1, 9), ("b", 1, 9), ("b", 1, 9), ("b", 2, 9), ("c", 1, 9), ("c", 1, None), (None, 1, 9)]
    order = sorted(old, key=lambda r: (r[2] is None, -(r[2] or 0), r[0] is not None, r[0] or "", r[1]))
    cache = spark.createDataFrame(old, "path string, size long, mtime long")
    for keep in range(len(old) + 2):
        got = [tuple(r) for r in thumbs.trimmed(cache, keep).collect()]
        assert sorted(got, key=str) == sorted(order[keep:], key=str), keep


def test_faces_of_repeated_file_rows(spark):
    faces = spark.createDataFrame([(1, 10, 0.5), (2, 11, 0.9), (3, 12, 0.7)], "id long, file_id long, confidence double").selectExpr("*", "0e0 as x", "0e0 as y", "0e0 as width", "0e0 as height")
    rows = spark.createDataFrame([(10, 1), (10, 1), (11, 1), (12, 2)], "id long, photo_id long")
    assert [r.id for r in people.faces_for_photo(faces, rows, 1).collect()] == [2, 1, 1]


def test_both_sides_take_the_same_row_of_an_id(spark, sf_dir):
    """Rows of one path and id that come in any order: the windows order them by what differs."""
    plan = QUERIES["reconcile_files"](spark, sf_dir)._jdf.queryExecution().analyzed().toString()
    windows = re.findall(r"row_number\(\) windowspecdefinition\(([^)]*)", plan)
    assert windows and all("size_bytes" in w and "mtime_ns" in w for w in windows)


# passes -----------------------------------------------------------------------------------------------------------


def seeded(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "cat"))
    photos = spark.createDataFrame([(i, 1, "d", f"s{i}", "raster_only", False, None) for i in range(1, 7)], "id long, library_id long, dir string, stem string, state string, needs_review boolean, trashed_at long")
    rows = spark.createDataFrame([(i * 10, 1, i, f"f{i}", "raster", 1, 2) for i in range(1, 7)], "id long, library_id long, photo_id long, path string, role string, size_bytes long, mtime_ns long")
    catalog.replace(photo=photos, file=rows)
    contents = spark.createDataFrame([(f"f{i}", bytearray(b"" if i == 6 else bytes([i % 2] * 4))) for i in range(1, 7)], "path string, content binary")
    return catalog, contents


def test_face_pass(spark, tmp_path):
    catalog, contents = seeded(spark, tmp_path)
    decode = lambda data: np.frombuffer(data, np.uint8) if data else None
    detector = passes.Detector("d1", lambda x: [(0.0, 0.0, 2.0, 2.0, 0.9, [0.0] * 10)])
    embedder = passes.Embedder("e1", lambda x, marks: np.eye(2)[int(x[0])])
    got = passes.face_pass(catalog, contents, decode, detector, embedder, 5, cutter(spark))
    assert got == {"detected_files": 5, "faces_found": 5, "unreadable": 1, "embedded": 5, "people": 2}
    groups = {}
    for r in catalog.table("person_face").join(catalog.table("face").selectExpr("id as face_id", "file_id"), "face_id").collect():
        groups.setdefault(r.person_id, set()).add(r.file_id)
    assert sorted(map(sorted, groups.values())) == [[10, 30, 50], [20, 40]]
    again = passes.face_pass(catalog, contents, decode, detector, embedder, 6, cutter(spark))
    assert (again["detected_files"], again["embedded"], again["people"]) == (0, 0, 2)


def test_clip_and_tag_pass(spark, tmp_path):
    catalog, contents = seeded(spark, tmp_path)
    vocabulary = spark.createDataFrame([("Zero ", [1.0, 0.0]), ("one", [0.0, 1.0]), ("both", [0.7, 0.7])], "phrase string, vector array<float>")
    decode = lambda data: np.frombuffer(data, np.uint8) if data else None
    got = passes.clip_pass(catalog, contents, decode, passes.Embedder("m", lambda x: np.eye(2)[int(x[0])]), vocabulary, 5, cutter(spark), keep=2)
    assert got == {"tagged": 5, "tags": 10, "unreadable": 1}
    assert {(r.photo_id, r.name) for r in catalog.table("tag").where("confidence > 0.9").collect()} == {(1, "one"), (2, "zero"), (3, "one"), (4, "zero"), (5, "one")}

    def client(data):
        if not data:
            raise passes.Unreachable("gone")
        if data[0] == 0:
            raise ValueError("no")
        return {"tags": [("A", 0.4), ("a ", 0.6)], "description": "  " if data == b"" else "text", "prompt_tokens": 3, "completion_tokens": 2}

    report = passes.tag_pass(catalog, contents.coalesce(1), client, "v", 5, 9, cutter(spark))
    assert (report["tagged"], report["failed"], report["asked"], report["remaining"], report["prompt_tokens"], report["stopped_because"]) == (3, 2, 5, 1, 9, None)
    assert {(r.photo_id, r.name, r.confidence) for r in catalog.table("tag").where("model = 'v'").collect()} == {(i, "a", 0.6) for i in (1, 3, 5)}
    assert catalog.table("photo_caption").count() == 3 and catalog.table("tag").where("model like 'clip:%'").count() == 10
    stopped = passes.tag_pass(catalog, contents.coalesce(1), client, "v", 50, 10, cutter(spark))
    assert (stopped["tagged"], stopped["stopped_because"]) == (0, "gone")


# vectors ----------------------------------------------------------------------------------------------------------


def test_blocks_give_what_one_matrix_gives(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5))
    ids = [int(i) for i in rng.choice(10**9, 60, replace=False)]
    df = spark.createDataFrame([(i, v.tolist(), int(k % 7)) for k, (i, v) in enumerate(zip(ids, x))], "id long, vector array<double>, person_id long")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = set()
    for i in range(60):
        near = sorted((-round(float(u[i] @ u[j]), 6), ids[j]) for j in range(60) if ids[j] > ids[i] and u[i] @ u[j] >= 0.3)[:8]
        want |= {(ids[i], j) for _, j in near}
    for block in (7, 2048):
        assert {(r.src, r.dst) for r in vectors.knn_graph(df, cutter(spark), block=block).collect()} == want
    phrases = spark.createDataFrame([(f"p{k}", v.tolist()) for k, v in enumerate(rng.normal(size=(30, 5)))], "phrase string, vector array<double>")
    members = df.withColumnRenamed("id", "face_id")
    images = df.withColumnRenamed("id", "photo_id")
    few, many = ([(r.photo_id, r.phrase, round(r.similarity, 6)) for r in vectors.rank_vocabulary(images, phrases, most_phrases=n).collect()] for n in (100, 4))
    assert sorted(few) == sorted(many) and few
    few, many = ([(r.face_id, round(r.own, 6), round(r.other, 6)) for r in vectors.ambiguous(members, 0.5, most_people=n).collect()] for n in (100, 3))
    assert few == many and few


def test_suppression_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(i % 3, i, rng.uniform(0, 20), rng.uniform(0, 20), rng.uniform(0, 9), rng.uniform(0, 9), rng.choice([0.5, 0.6, 0.9])) for i in range(90)]
    df = spark.createDataFrame(rows, "image long, id long, x double, y double, w double, h double, confidence double")

    def iou(a, b):
        w = max(0, min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]))
        h = max(0, min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3]))
        union = a[4] * a[5] + b[4] * b[5] - w * h
        return w * h / union if union > 0 else 0

    kept = []
    for r in sorted(rows, key=lambda r: (-r[6], r[1])):
        if all(k[0] != r[0] or iou(k, r) <= 0.3 for k in kept):
            kept.append(r)
    assert {r.id for r in vectors.suppress(df).collect()} == {r[1] for r in kept}


def test_sweep_and_order(spark):
    cut = cutter(spark)
    rows = vectors.synthetic(spark, 6, 8, 24, 0.2)
    found = {r.k: r for r in vectors.sweep(rows, [2, 8], cut).collect()}
    assert found[8].precision == 1.0 and found[8].recall == 1.0 and found[8].clusters == 6 and found[8].purity == 1.0
    assert found[2].recall <= 1.0
    assert "K3 1.000" in vectors.summary(vectors.sweep(rows, [8], cut)).first().line
    df = spark.createDataFrame([(1, 1, 2), (4, 1, 2), (2, 2, 3), (3, 2, 3), (9, 2, 3), (0, 0, 2), (7, 0, 2)], "id long, cluster long, size long")
    assert [(r.cluster, r.members) for r in vectors.ordered_clusters(df).collect()] == [(2, [2, 3, 9]), (0, [0, 7]), (1, [1, 4])]


# streams ----------------------------------------------------------------------------------------------------------


def test_changes_wait_while_a_delete_is_pending(spark, tmp_path):
    d = settle.Deferred(spark, str(tmp_path / "wait"))
    one = spark.createDataFrame([("a", "appeared", 1), ("b", "vanished", 1)], "path string, change string, at long")
    two = spark.createDataFrame([("a", "vanished", 5)], one.schema)
    assert d.pending() == 0
    d.add(one)
    assert d.pending() == 2
    assert {tuple(r) for r in d.with_waiting(two).select("path", "change").collect()} == {("a", "vanished"), ("b", "vanished")}
    d.clear()
    assert d.pending() == 0 and d.with_waiting(two).count() == 1


def test_progress_and_polling(spark, tmp_path):
    p = progress.Progress()
    for done, now in ((0, 0.0), (3, 1.0), (1, 2.0), (30, 10.0)):
        p.record(done, 100, now)
    assert (p.highest, p.share, p.rate) == (30, 0.3, 3.0) and p.eta == pytest.approx(70 / 3)
    p.record(31, 0, 11.0)
    assert p.share is None and p.eta is None
    (tmp_path / "a.jpg").write_bytes(b"1")
    w = progress.PollWatcher(spark, str(tmp_path), 0.01)
    assert not w.changed()
    import os

    os.utime(tmp_path / "a.jpg", (2_000_000_000, 2_000_000_000))
    stop, seen = threading.Event(), []
    w.run(lambda: (seen.append(1), stop.set()), stop)
    assert seen == [1]


def test_catalog_keeps_the_last_whole_state(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "cat"))
    c.replace(setting=spark.createDataFrame([("a", "1", 1)], "key string, value string, updated_at long"))
    # a writer that died before its pointer was whole
    (tmp_path / "cat" / "catalog.json.new").write_text('{"ver')
    assert Catalog(spark, str(tmp_path / "cat")).table("setting").count() == 1
    assert json.loads(json.dumps(c._read()))["version"]
    assert tables.upsert(c.table("setting"), c.table("setting"), ["key"]).count() == 1


# what models are given --------------------------------------------------------------------------------------------


def test_model_inputs():
    from fotolith.functions import modelinput as m

    rgb = np.zeros((50, 100, 3), np.uint8)
    rgb[..., 0], rgb[..., 2] = 200, 10
    planes, scale, left, top = m.detector_input(rgb, 64)
    assert planes.shape == (3, 64, 64) and (scale, left, top) == (0.64, 0.0, 16.0)
    assert planes[0, 32, 32] == 10 and planes[2, 32, 32] == 200 and not planes[:, :15].any() and not planes[:, 49:].any()
    assert m.outputs({"a": np.ones((2, 2))}, "a").tolist() == [1, 1, 1, 1]
    with pytest.raises(ValueError, match="no output"):
        m.outputs({}, "b")
    seen = []
    model = lambda x: (seen.append(x.shape), np.arange(128.0))[1]
    marks = [38.2946, 51.6963, 73.5318, 51.5014, 56.0252, 71.7366, 41.5493, 92.3655, 70.7299, 92.2041]
    assert len(m.embed_face(np.ones((120, 120, 3)), marks, model)) == 128 and seen == [(1, 3, 112, 112)]
    with pytest.raises(ValueError, match="instead of 128"):
        m.embed_aligned(np.ones((112, 112, 3)), lambda x: np.ones(4))
    with pytest.raises(ValueError, match="aligned"):
        m.embed_aligned(np.ones((10, 112, 3)), model)
    v = m.embed_picture(rgb, lambda x: x.ravel()[:5], np.zeros(3), np.ones(3))
    assert abs(float(np.linalg.norm(v)) - 1) < 1e-6
    small = m.sent_picture(np.full((300, 1536, 3), 77, np.uint8))
    assert small.shape == (150, 768, 3) and (small == 77).all()


def test_endpoint():
    from fotolith.sources import endpoint as e

    sent = []

    def transport(method, url, body, seconds):
        sent.append((method, url, body))
        if url.endswith("/health"):
            return 200, b"ok"
        if url.endswith("/models"):
            return 200, b'{"data": [{"id": "m"}, {}]}'
        if b"enable_thinking" in body:
            return 400, b""
        said = '```json\n{"tags": [{"name": "Sea", "confidence": 0.4}, {"name": "sea ", "confidence": 0.9}, {"name": " ", "confidence": 1}], "description": " "}\n```'
        return 200, json.dumps({"choices": [{"message": {"content": said}}], "usage": {"prompt_tokens": 7, "completion_tokens": 3}}).encode()

    server = e.Endpoint("http://10.0.0.7:8000/", "m", e.Egress(transport=transport), ("sea",))
    assert server.healthy() and server.models() == ["m"]
    assert server.tag(b"abc") == {"tags": [("sea", 0.9)], "description": None, "prompt_tokens": 7, "completion_tokens": 3}
    assert "data:image/jpeg;base64,YWJj" in sent[-1][2].decode() and len(sent) == 4
    with pytest.raises(e.Blocked):
        e.Egress(transport=transport).fetch("http://example.com/")
    for bad in (b'{"choices": []}', b'{"choices": [{"message": {"content": ""}}]}', b'{"choices": [{"message": {"content": "no"}}]}'):
        with pytest.raises(ValueError):
            e.parsed(bad)

    def down(*_):
        raise ConnectionError("down")

    with pytest.raises(passes.Unreachable):
        e.Endpoint("http://localhost", "m", e.Egress(transport=down)).tag(b"")


def test_policy_is_the_column_rule(spark):
    from fotolith.functions import media
    from fotolith.sources.endpoint import Policy

    urls = ["http://10.1.2.3/", "https://8.8.8.8", "http://172.31.0.1:80/x", "http://172.32.0.1", "http://100.64.1.1", "http://100.128.1.1", "http://[::1]:1/", "http://[fd00::1]/", "http://[2001:db8::1]/", "https://u@GitHub.com:443/a", "https://evilgithub.com", "http://a.localhost/", "nothing", "http://", "http://169.254.0.1", "http://192.168.1.1?x", "http://[fe80::1]/"]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", media.permits(F.col("u")).alias("ok")).collect()
    assert {r.u: r.ok for r in rows} == {u: Policy().permits(u) for u in urls}
    assert Policy(extra=("Example.com",)).permits("http://example.COM/") and Policy(unrestricted=True).permits("http://example.com")
