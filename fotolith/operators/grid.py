"""The grid: the view of photographs, filters in two dialects, sorts, counts, facets and folders."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fotolith.functions import paths as P
from fotolith.functions.media import band
from fotolith.operators.numbering import numbered


def photo_view(photos: DataFrame, scores: DataFrame, decisions: DataFrame, metadata: DataFrame, quality: DataFrame) -> DataFrame:
    """Visible photographs with score, decision, metadata and quality where there are any; unrated by default."""
    v = photos.where("trashed_at is null").join(scores.select("photo_id", "composite"), photos.id == scores.photo_id, "left").drop("photo_id")
    for other in (decisions, metadata, quality):
        v = v.join(other, v.id == other.photo_id, "left").drop("photo_id")
    return v.withColumns({"rating": F.coalesce("rating", F.lit(0)), "rejected": F.coalesce("rejected", F.lit(False)), "band": band(F.col("composite"))})


def with_pending_decisions(view: DataFrame, pending: DataFrame) -> DataFrame:
    """Decisions not yet stored win over stored ones."""
    p = pending.select(F.col("photo_id").alias("id"), F.col("rating").alias("__r"), F.col("rejected").alias("__x"))
    return view.join(p, "id", "left").withColumns({"rating": F.coalesce("__r", "rating"), "rejected": F.coalesce("__x", "rejected")}).drop("__r", "__x")


@dataclass(frozen=True)
class Filters:
    """What is shown. ``dialect`` web or native: they differ in unscored frames, search and empty choices."""

    dialect: str = "web"
    band: str | None = None
    decision: str | None = None
    quality: str | None = None
    camera: str | None = None
    lens: str | None = None
    year: int | None = None
    search: str = ""
    folder: str | None = None

    def active(self) -> bool:
        return any([self.band, self.decision, self.quality, self.camera, self.lens, self.year, self.search.strip(), self.folder])

    def predicate(self) -> Column:
        web = self.dialect == "web"
        out = F.lit(True)
        if self.folder:
            out &= (F.col("dir") == self.folder) | F.startswith("dir", F.lit(self.folder.rstrip("/") + "/"))
        if self.band:
            out &= band_is(self.band, self.dialect)
        if self.decision:
            out &= DECISIONS[self.decision]()
        if self.quality and not web:
            out &= QUALITIES[self.quality]()
        for name in ("camera", "lens", "year"):
            wanted = getattr(self, name)
            if wanted if web else wanted is not None:
                out &= F.col(name) == wanted
        if q := self.search.strip():
            if web:
                out &= F.contains(F.lower("stem"), F.lower(F.lit(q)))
            else:
                out &= F.contains(F.collate("stem", "UNICODE_CI_AI"), F.collate(F.lit(q), "UNICODE_CI_AI"))
        return F.coalesce(out, F.lit(False))


def band_is(name: str, dialect: str) -> Column:
    return (F.coalesce("band", F.lit("review")) if dialect == "web" else F.col("band")) == name


DECISIONS = {
    "all": lambda: F.lit(True),
    "unrated": lambda: (F.col("rating") == 0) & ~F.col("rejected"),
    "rated": lambda: F.col("rating") > 0,
    "rejected": lambda: F.col("rejected"),
}
QUALITIES = {
    "soft": lambda: F.coalesce(F.col("focus") <= 10, F.lit(False)),
    "noisy": lambda: F.coalesce(F.col("noise") >= 90, F.lit(False)),
    "low_detail": lambda: F.coalesce(F.col("detail") <= 10, F.lit(False)),
    "sharp": lambda: F.coalesce(F.col("focus") >= 75, F.lit(False)),
}


#: Sort orders: column, descending, and whether ties by id are descending. Nulls are last in every order.
ORDERS = {
    "ranked": (("dir", False), ("stem", False)),
    "name": (("stem", False), ("id", False)),
    "name_desc": (("stem", True), ("id", True)),
    "newest": (("captured_at", True), ("id", False)),
    "oldest": (("captured_at", False), ("id", False)),
    "sharpest": (("focus", True), ("id", False)),
    "score": (("composite", True), ("id", False)),
}


def order_of(by: str) -> list[Column]:
    return [F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in ORDERS[by]]


def sort(view: DataFrame, by: str = "ranked") -> DataFrame:
    return view.orderBy(*order_of(by))


def positions(view: DataFrame, by: str, checkpoint, name: str = "position") -> DataFrame:
    """The view with each row's place in a sort order, from 1."""
    return numbered(view, order_of(by), checkpoint, name)


def narrow(view: DataFrame, *ids: DataFrame) -> DataFrame:
    """Only photographs that every one of the given sets of photo ids has."""
    for s in ids:
        view = view.join(s.select(F.col("photo_id").alias("id")), "id", "left_semi")
    return view


def narrow_native(view: DataFrame, filters: Filters, *, tag: DataFrame | None = None, person: DataFrame | None = None) -> DataFrame:
    """What is shown in the native dialect: a tag or a person (photo ids), not both, narrows and wins over the folder."""
    if tag is not None and person is not None:
        raise ValueError("a tag or a person")
    chosen = tag if tag is not None else person
    if chosen is None:
        return view.where(filters.predicate())
    return narrow(view, chosen).where(replace(filters, folder=None).predicate())


def selected(view: DataFrame, ids: DataFrame, by: str = "ranked") -> DataFrame:
    """The chosen ids (id) that are visible, in the visible order."""
    return sort(view.join(ids.select("id").distinct(), "id", "left_semi"), by).select("id")


def select_range(view: DataFrame, by: str, first: int, last: int) -> DataFrame:
    """Rows between two ids in a sort order, both included, whichever comes first; nothing if either isn't there. The rows
    are compared with the sort keys of the two, so nothing is numbered."""

    def before(a: dict[str, Column], b: dict[str, Column]) -> Column:
        """Whether a isn't behind b."""
        out = F.lit(True)
        for c, down in reversed(ORDERS[by]):
            x, y = a[c], b[c]
            less = F.coalesce((x > y) if down else (x < y), x.isNotNull() & y.isNull())
            out = F.when(less, True).when(x.eqNullSafe(y), out).otherwise(False)
        return out

    names = [c for c, _ in ORDERS[by]]
    keys = F.struct(*names)
    ends = view.where(F.col("id").isin(first, last)).agg(F.max(F.when(F.col("id") == first, keys)).alias("__a"), F.max(F.when(F.col("id") == last, keys)).alias("__b"))
    rows = view.crossJoin(F.broadcast(ends.where("__a is not null and __b is not null")))  # one row
    own, a, b = {c: F.col(c) for c in names}, *({c: F.col(f"__{e}.{c}") for c in names} for e in "ab")
    return rows.where((before(a, own) & before(own, b)) | (before(b, own) & before(own, a))).drop("__a", "__b")


def filter_counts(view: DataFrame, dialect: str = "web") -> DataFrame:
    """(kind, name, n) of every band, decision and quality choice, over the unfiltered list."""
    named = [("band", b, band_is(b, dialect)) for b in ("keep", "review", "reject")] + [("decision", d, f()) for d, f in DECISIONS.items()] + [("quality", q, f()) for q, f in QUALITIES.items()]
    row = view.agg(*(F.count_if(c).alias(f"{k}:{n}") for k, n, c in named))
    made = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(n).alias("name"), F.col(f"`{k}:{n}`").alias("n")) for k, n, _ in named))
    return row.select(F.explode(made).alias("x")).select("x.*")


def facets(view: DataFrame, names: tuple[str, ...] = ("camera", "lens", "year")) -> DataFrame:
    """(facet, value, n) for every value there is, in one pass."""
    cells = F.array(*(F.struct(F.lit(n).alias("facet"), F.col(n).cast("string").alias("value")) for n in names))
    return view.select(F.explode(cells).alias("x")).where("x.value is not null and x.value != ''").groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def directories(photos: DataFrame) -> DataFrame:
    """(path, direct, recursive) of every folder with visible photographs in or below it. The root "/" of absolute paths is
    listed too, but counts only what lies directly in it."""
    counts = photos.where("trashed_at is null").groupBy("dir").agg(F.count("*").alias("k"))
    inner = F.startswith("dir", F.lit("/")) & (F.col("dir") != "/")
    every = F.concat(P.ancestors(F.col("dir")), F.when(inner, F.array(F.lit("/"))).otherwise(F.array().cast("array<string>")))
    up = counts.select("dir", "k", F.explode(every).alias("path"))
    direct = F.sum(F.when(F.col("path") == F.col("dir"), F.col("k")).otherwise(0))
    return up.groupBy("path").agg(direct.alias("direct"), F.sum(F.when((F.col("path") == "/") & (F.col("dir") != "/"), 0).otherwise(F.col("k"))).alias("recursive"))


def folder_tree(dirs: DataFrame) -> DataFrame:
    """(path, name, depth, parent, direct, recursive) with a row for every folder on the way, counted 0, in the order of a
    tree whose siblings are sorted by name with numbers by value."""
    rows = dirs.select("path", "direct", "recursive")
    chain = rows.select(F.explode(P.ancestors(F.col("path"))).alias("path")).distinct().where("path != ''").join(rows, "path", "left")
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    padded = F.transform(parts, lambda x: F.array_join(F.transform(F.regexp_extract_all(F.lower(x), F.lit("[0-9]+|[^0-9]+"), F.lit(0)), lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, 24, "0")).otherwise(p)), ""))
    up = F.regexp_replace("path", "/[^/]+$", "")
    out = chain.select("path", F.coalesce(F.try_element_at(parts, F.lit(-1)), F.col("path")).alias("name"), F.size(parts).alias("depth"), F.nullif(F.when(up != F.col("path"), up), F.lit("")).alias("parent"), F.coalesce("direct", F.lit(0)).alias("direct"), F.coalesce("recursive", F.lit(0)).alias("recursive"), padded.alias("__order"))
    return out.orderBy("__order", "path").drop("__order")


def folders_below(dirs: DataFrame, root: str) -> DataFrame:
    """Folders relative to the library's root, without the root itself and whatever lies outside."""
    root = root.rstrip("/") + "/"
    return dirs.where(F.startswith("path", F.lit(root))).withColumn("path", F.substring("path", len(root) + 1, F.length("path")))


def pivot_quality(scores: DataFrame, names: tuple[str, ...] = ("focus", "noise", "detail")) -> DataFrame:
    """(photo_id, one column a metric) from rows of (photo_id, metric, value); absent stays null."""
    return scores.where(F.col("metric").isin(*names)).groupBy("photo_id").agg(*(F.max(F.when(F.col("metric") == n, F.col("value"))).alias(n) for n in names))


def first_metadata(files: DataFrame, exif: DataFrame) -> DataFrame:
    """The whole metadata row of each photograph's first file that has one: raws first, then by id."""
    w = Window.partitionBy("photo_id").orderBy(F.when(F.col("role") == "raw", 0).otherwise(1), "id")
    return files.join(exif, files.id == exif.file_id).withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")
