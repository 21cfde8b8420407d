"""From measurements to scores: ranks in shoot and library, weighted composite, band, explanation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotolith.functions.media import band, ordinal
from fotolith.operators.ranks import library_mid_rank, mid_rank
from fotolith.operators.sessions import SHOOT_GAP, shoots
from fotolith.schemas import HIGHER_BETTER

MIN_SHOOT = 8
# Weights of focus, detail, tonal range, clipping and noise for each kind of photography.
PRESETS = {
    "Balanced": (30, 20, 15, 20, 15),
    "Portrait": (30, 15, 10, 20, 25),
    "Landscape": (30, 25, 25, 15, 5),
    "Wildlife": (40, 25, 10, 10, 15),
    "Event": (25, 15, 15, 20, 25),
    "Street": (25, 20, 25, 15, 15),
}
TERMS = ("focus", "detail", "tonal range", "clipping", "noise")
# The wording of an explanation.
IN_SHOOT, IN_LIBRARY = ("of ", " in this shoot"), ("across the library; this shoot has only ", " frames")
NOTHING_UP, NOTHING_DOWN = "  nothing above average for this shoot", "  nothing below average for this shoot"
RANGE_USED, AT_EXTREME, NO_CLIPPING = "% of the range used", "% of pixels at an extreme", "no clipping"
_M = [f"m{i}" for i in range(8)]


def reference(relative: Column, size: Column) -> Column:
    """What a rank refers to, in words."""
    near, far = (F.concat(F.lit(a), size, F.lit(b)) for a, b in (IN_SHOOT, IN_LIBRARY))
    return F.when(relative, near).otherwise(far)


def preset(name: str) -> tuple[int, ...]:
    found = {k.lower(): v for k, v in PRESETS.items()}
    if name.lower() not in found:
        raise KeyError(name)
    return found[name.lower()]


#: The metrics that a score reads.
SCORED = tuple(i for i, better in enumerate(HIGHER_BETTER) if better is not None)


def normalise(frames: DataFrame, gap: int = SHOOT_GAP, metrics: tuple[int, ...] = tuple(range(8)), library_for_all: bool = True) -> DataFrame:
    """frames (photo_id, dir, camera, captured_at, m0..m7) with shoot columns, shoot_relative, s0..s7 (rank in the
    shoot) and l0..l7 (rank in the library), null for metrics that aren't asked for.

    The metrics are unpivoted first: all share one sort by shoot, and the library's ranks come from counts of values,
    not from a window over everything. Without ``library_for_all`` only frames of small shoots, whose score needs
    them, get ranks in the library.
    """
    base = shoots(frames, gap).withColumn("shoot_relative", F.col("shoot_size") >= MIN_SHOOT)
    cells = F.array(*(F.struct(F.lit(i).alias("metric"), F.col(f"m{i}").alias("value")) for i in metrics))
    long = base.select("photo_id", "shoot_id", "shoot_relative", F.explode(cells).alias("x")).select("photo_id", "shoot_id", "shoot_relative", "x.metric", "x.value")
    ranked = long.withColumn("in_shoot", mid_rank(["shoot_id", "metric"], "value"))
    if library_for_all:
        ranked = library_mid_rank(ranked, ["metric"], "value", "in_library")
    else:
        small = ranked.where(~F.col("shoot_relative"))
        ranked = ranked.where("shoot_relative").withColumn("in_library", F.lit(None).cast("double")).unionByName(library_mid_rank(small, ["metric"], "value", "in_library", of=long))
    wide = ranked.groupBy("photo_id").agg(*((F.max(F.when(F.col("metric") == i, F.col(c))) if i in metrics else F.lit(None).cast("double")).alias(f"{p}{i}") for c, p in (("in_shoot", "s"), ("in_library", "l")) for i in range(8)))
    return base.join(wide, "photo_id")


def oriented(i: int) -> Column:
    """A metric's percentile, in the shoot if that is large enough, turned so that higher is better; null if unranked."""
    if HIGHER_BETTER[i] is None:
        return F.lit(None).cast("double")
    p = F.when(F.col("shoot_relative"), F.col(f"s{i}")).otherwise(F.col(f"l{i}"))
    return p if HIGHER_BETTER[i] else 100 - p


def terms(weights: tuple[float, ...]) -> Column:
    """array<struct<label, weight, percentile, raw, contribution, loss>> of the five terms; one without a percentile is
    left out, clipping if either side has none."""
    total = float(sum(weights))
    values = (
        (oriented(0), F.col("m0")),
        (oriented(1), F.col("m1")),
        (oriented(4), F.col("m4")),
        (F.when(oriented(5).isNotNull() & oriented(6).isNotNull(), F.least(oriented(5), oriented(6))), F.greatest("m5", "m6")),
        (oriented(7), F.col("m7")),
    )
    out = []
    for label, weight, (p, raw) in zip(TERMS, weights, values, strict=True):
        w = weight / total
        p = F.when(p.isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(0.0), p)))
        out.append(F.struct(F.lit(label).alias("label"), F.lit(w).alias("weight"), p.alias("percentile"), raw.alias("raw"), (p * w).alias("contribution"), ((100 - p) * w).alias("loss")))
    return F.filter(F.array(*out), lambda t: t["percentile"].isNotNull())


def valid_weights(weights: tuple[float, ...]) -> bool:
    return len(weights) == 5 and all(w >= 0 for w in weights) and sum(weights) > 0


def valid_thresholds(keep: float, reject: float) -> bool:
    return 0 <= reject < keep <= 100  # NaN fails too


def score(normalised: DataFrame, weights: tuple[float, ...] = PRESETS["Balanced"], keep: float = 70.0, reject: float = 35.0) -> DataFrame:
    """With terms, composite and band. Weights that can't be used give composite 0, band review and no terms."""
    if not valid_weights(weights):
        return normalised.withColumns({"terms": F.filter(terms((1, 1, 1, 1, 1)), lambda t: F.lit(False)), "composite": F.lit(0.0), "band": F.lit("review")})
    rows = normalised.withColumn("terms", terms(weights))
    total = F.aggregate("terms", F.lit(0.0), lambda s, t: s + t["contribution"])
    rows = rows.withColumn("composite", F.least(F.lit(100.0), F.greatest(F.lit(0.0), total)))
    return rows.withColumn("band", band(F.col("composite"), keep, reject))


def at_ideal(t: Column) -> Column:
    return ((t["label"] == "clipping") & (t["raw"] <= 0.001)) | ((t["label"] == "noise") & (t["raw"] <= 0.0))


def _by(field: str):
    return lambda a, b: F.when(a[field] > b[field], -1).when(a[field] < b[field], 1).otherwise(0)


def contributors(t: Column, n: int = 2) -> Column:
    return F.slice(F.array_sort(F.filter(t, lambda x: x["percentile"] > 50), _by("contribution")), 1, n)


def detractors(t: Column, n: int = 2, shown: Column | None = None) -> Column:
    def costs(x: Column) -> Column:
        ok = (x["percentile"] < 50) & ~at_ideal(x)
        return ok if shown is None else ok & ~F.exists(shown, lambda y: y["label"] == x["label"])

    return F.slice(F.array_sort(F.filter(t, costs), _by("loss")), 1, n)


def _fixed(x: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", F.bround(x, places))


def describe(t: Column) -> Column:
    p = t["percentile"]
    grade = F.when(p >= 90, "excellent").when(p >= 70, "good").when(p >= 40, "average").when(p >= 15, "weak").otherwise("poor")
    name = F.concat(t["label"], F.lit(" "), grade)
    return (
        F.when(t["label"].isin("focus", "detail"), name)
        .when(t["label"] == "tonal range", F.concat(name, F.lit(" — "), _fixed(t["raw"] * 100, 0), F.lit(RANGE_USED)))
        .when((t["label"] == "clipping") & (t["raw"] <= 0.001), NO_CLIPPING)
        .when(t["label"] == "clipping", F.concat(name, F.lit(" — "), _fixed(t["raw"] * 100, 1), F.lit(AT_EXTREME)))
        .otherwise(F.concat(name, F.lit(" (sigma "), _fixed(t["raw"], 1), F.lit(")")))
    )


def explain(scored: DataFrame, preset_name: str = "Balanced") -> DataFrame:
    """photo_id and the lines that explain its score."""
    ref = reference(F.col("shoot_relative"), F.col("shoot_size").cast("string"))
    rows = scored.withColumns({"__ref": ref, "__up": contributors(F.col("terms"))})
    rows = rows.withColumns({"__down": detractors(F.col("terms"), 2, F.col("__up")), "__any": detractors(F.col("terms"), 2)})
    head = F.concat(F.initcap("band"), F.lit(" — "), _fixed(F.col("composite"), 0), F.lit(f"/100 ({preset_name}, ranked "), F.col("__ref"), F.lit(")"))

    def lines(of: str, sign: str) -> Column:
        return F.transform(of, lambda t: F.concat(F.lit(f"  {sign} "), describe(t), F.lit(" ("), ordinal(t["percentile"]), F.lit(" percentile "), F.col("__ref"), F.lit(")")))

    empty = F.array().cast("array<string>")
    none_up = F.when(F.size("__up") == 0, F.array(F.lit(NOTHING_UP))).otherwise(empty)
    none_down = F.when(F.size("__any") == 0, F.array(F.lit(NOTHING_DOWN))).otherwise(empty)
    return rows.select("photo_id", F.concat(F.array(head), lines("__up", "+"), lines("__down", "−"), none_up, none_down).alias("lines"))


def score_rows(scored: DataFrame, version: str, now: int) -> DataFrame:
    """Rows of the score table: composite, band (keep 2, review 1, reject 0), shoot_size, shoot_relative, the terms."""
    number = F.when(F.col("band") == "keep", 2.0).when(F.col("band") == "review", 1.0).otherwise(0.0)
    fixed = [("composite", F.col("composite")), ("band", number), ("shoot_size", F.col("shoot_size").cast("double")), ("shoot_relative", F.col("shoot_relative").cast("int").cast("double"))]
    values = F.concat(F.array(*(F.struct(F.lit(n).alias("metric"), v.alias("value")) for n, v in fixed)), F.transform("terms", lambda t: F.struct(F.concat(F.lit("term:"), F.regexp_replace(t["label"], " ", "_")).alias("metric"), t["percentile"].alias("value"))))
    return scored.select("photo_id", F.explode(values).alias("x")).select("photo_id", "x.metric", "x.value", F.lit(version).alias("scorer_version"), F.lit(now).cast("long").alias("computed_at"))


def baselines(frames: DataFrame) -> DataFrame:
    """(shoot_id, anisotropy, detail, focus): medians of the finite values of each shoot."""

    def finite(c: str) -> Column:
        return F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c))

    return frames.groupBy("shoot_id").agg(*(F.median(finite(m)).alias(n) for m, n in (("m2", "anisotropy"), ("m1", "detail"), ("m0", "focus"))))


def motion_candidates(frames: DataFrame) -> DataFrame:
    """Frames far more directional and far less detailed than their shoot."""
    base = baselines(frames).withColumnsRenamed({"anisotropy": "__a", "detail": "__d", "focus": "__f"})
    return frames.join(base, "shoot_id").where("m2 > 2.5 * __a and m1 < 0.6 * __d").select(frames.columns)
