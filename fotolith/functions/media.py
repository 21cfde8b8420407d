"""Cameras, dates, texts and other scalar rules of the catalog."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType

_SPACES = " \t\n\r\x0b\x0c"


def _nonblank(c: Column) -> Column:
    return F.nullif(F.trim(c, F.lit(_SPACES)), F.lit(""))


def clean(c: Column) -> Column:
    """Without white space and NULs around."""
    return F.trim(F.trim(F.trim(c, F.lit(_SPACES)), F.lit("\x00")), F.lit(_SPACES))


def camera_name(make: Column, model: Column) -> Column:
    """One name of make and model: the model alone where it names the make already."""
    mk, md = _nonblank(make), _nonblank(model)
    first = F.element_at(F.split(mk, r"\s+"), 1)
    named = F.lower(md).startswith(F.lower(mk)) | ((F.size(F.split(mk, r"\s+")) > 1) & (F.octet_length(first) >= 3) & F.lower(md).startswith(F.lower(first)))
    return F.when(mk.isNull(), md).when(md.isNull(), mk).when(named, md).otherwise(F.concat_ws(" ", mk, md))


def detail_camera(make: Column, model: Column) -> Column:
    """The detail pane's own rule: a plain prefix test, blanks kept."""
    return F.when(make.isNull(), model).when(model.isNull(), make).when(F.lower(model).startswith(F.lower(make)), model).otherwise(F.concat_ws(" ", make, model))


def camera_key(make: Column, model: Column) -> Column:
    return F.coalesce(_nonblank(model), _nonblank(make))


def exposure_signature(iso: Column, seconds: Column) -> Column:
    return F.when(iso.isNotNull() & seconds.isNotNull(), F.struct(iso.alias("iso"), (seconds * 1e6).cast("long").alias("micros")))


def civil_days(y: Column, m: Column, d: Column) -> Column:
    """Day number of a proleptic Gregorian date; a day past the month's end rolls into the next month."""
    first = F.datediff(F.make_date(y, m, F.lit(1)), F.lit("1970-01-01").cast("date"))
    return (first + d - 1).cast("long")


def exif_time(text: Column) -> Column:
    """Epoch seconds of a camera's local time, or null. Fractions and zones are dropped; 31 February rolls on."""
    t = F.trim(text, F.lit(_SPACES))
    parts = F.split(t, "[ T]", 2)
    date, clock = F.split(F.get(parts, F.lit(0)), "[:-]"), F.split(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), ":")

    def number(c: Column) -> Column:
        return F.expr("cast(null as int)") if c is None else F.when(c.rlike(r"^\+?[0-9]{1,9}$"), c.cast("int"))

    y, m, d = (number(F.get(date, F.lit(i))) for i in range(3))
    hh, mi = (F.coalesce(number(F.get(clock, F.lit(i))), F.lit(0)) for i in range(2))
    ss = F.coalesce(number(F.regexp_extract(F.coalesce(F.get(clock, F.lit(2)), F.lit("")), r"^([0-9]*)", 1)), F.lit(0))
    ok = (F.size(date) >= 3) & (y > 0) & (y <= 9999) & m.between(1, 12) & d.between(1, 31) & hh.between(0, 23) & mi.between(0, 59) & ss.between(0, 60)
    return F.when(ok, civil_days(F.when(ok, y), F.when(ok, m), d) * 86400 + hh * 3600 + mi * 60 + ss)


def civil_date(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")


def ordinal(v: Column) -> Column:
    """1st, 2nd, 3rd, 11th."""
    n = F.round(v).cast("long")
    a = F.abs(n)
    suffix = F.when((a % 100).between(11, 13), "th").when(a % 10 == 1, "st").when(a % 10 == 2, "nd").when(a % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), suffix)


def band(composite: Column, keep: float = 70.0, reject: float = 35.0) -> Column:
    return F.when(composite >= keep, "keep").when(composite < reject, "reject").when(composite.isNotNull(), "review")


def rating(v: Column) -> Column:
    return F.least(v, F.lit(5))


def unrated(r: Column, rejected: Column) -> Column:
    return (r == 0) & ~rejected


def epoch_text(seconds: Column) -> Column:
    """Epoch seconds as a date and time of day in UTC; "unknown" for null."""
    day = F.date_format(F.date_from_unix_date(F.floor(seconds / 86400).cast("int")), "yyyy-MM-dd")
    rest = F.pmod(seconds, F.lit(86400))
    clock = F.format_string("%02d:%02d", F.floor(rest / 3600), F.floor(rest % 3600 / 60))
    return F.coalesce(F.concat(day, F.lit(" "), clock, F.lit(" UTC")), F.lit("unknown"))


def tag_name(name: Column) -> Column:
    return F.nullif(F.lower(F.trim(name, F.lit(_SPACES))), F.lit(""))


def strip_fence(text: Column) -> Column:
    """The inside of a reply fenced as markdown code."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text, F.lit(_SPACES)), r"^```[A-Za-z]*", ""), r"```$", ""), F.lit(_SPACES))


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def hash_distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def usable_range(high: Column, low: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - high - low))


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Overlap of two boxes (x, y, w, h): intersection by union, 0 without area."""
    w = F.greatest(F.lit(0.0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    h = F.greatest(F.lit(0.0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    union = a["w"] * a["h"] + b["w"] * b["h"] - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """0 for different lengths, no elements or no length."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (length > 1.1920929e-07), dot(a, b) / length).otherwise(0.0)


# Hosts that may be reached by name.
ALLOWED_HOSTS = ["github.com", "objects.githubusercontent.com", "raw.githubusercontent.com", "huggingface.co", "cdn-lfs.huggingface.co"]


def host(url: Column) -> Column:
    """Lower-cased host of a URL, without user and port; brackets of an IPv6 address removed; null without a scheme."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    bare = F.regexp_replace(authority, r"^.*@", "")
    named = F.when(bare.startswith("["), F.regexp_extract(bare, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(bare, r":[0-9]*$", ""))
    return F.nullif(F.lower(named), F.lit(""))


def _ipv4(h: Column) -> Column:
    """An IPv4 address as a number, else null."""
    p = F.when(h.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), F.split(h, r"\."))
    n = [F.get(p, F.lit(i)).cast("long") for i in range(4)]
    return F.when((n[0] < 256) & (n[1] < 256) & (n[2] < 256) & (n[3] < 256), n[0] * 16777216 + n[1] * 65536 + n[2] * 256 + n[3])


#: First and last address of private, loopback, link-local and carrier-grade ranges.
_PRIVATE = [(10 << 24, (11 << 24) - 1), (127 << 24, (128 << 24) - 1), (0xA9FE0000, 0xA9FEFFFF), (0xAC100000, 0xAC1FFFFF), (0xC0A80000, 0xC0A8FFFF), (0x64400000, 0x647FFFFF)]


def is_private_host(h: Column) -> Column:
    ip = _ipv4(h)
    out = F.lit(False)
    for a, b in _PRIVATE:
        out = out | F.coalesce(ip.between(a, b), F.lit(False))
    return out | (h == "::1") | h.rlike("^f[cd][0-9a-f]{2}:") | h.rlike("^fe[89ab][0-9a-f]:") | (h == "localhost") | h.endswith(".localhost")


def permits(url: Column) -> Column:
    """Whether the engine may send to a URL: private addresses and named hosts only."""
    h = host(url)
    return F.coalesce(is_private_host(h) | h.isin(ALLOWED_HOSTS), F.lit(False))


def gpu_vendor(name: Column) -> Column:
    n = F.lower(name)

    def has(words: list[str]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(n, F.lit(w))
        return out

    return F.when(has(["nvidia", "geforce", "quadro", "rtx"]), "nvidia").when(has(["amd", "radeon"]), "amd").when(has(["apple", "m1", "m2", "m3", "m4"]), "apple").when(has(["intel", "iris", "uhd graphics"]), "intel").otherwise("unknown")


def hardware_tier(healthy: Column, vram: Column, ram: Column, apple: Column) -> Column:
    """remote, local_large, local_mid, local_small or cpu_only; memory in bytes, 70 % of it counts where it is shared."""
    gib = 1024.0**3
    best = F.coalesce(vram.cast("double"), F.when(apple, F.floor(ram * 0.70).cast("double")))
    return F.when(healthy, "remote").when(best >= 20 * gib, "local_large").when(best >= 12 * gib, "local_mid").when(best >= 6 * gib, "local_small").otherwise("cpu_only")


@F.pandas_udf(BinaryType())
def encode_vector(v: pd.Series) -> pd.Series:
    """Floats as little-endian bytes."""
    return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())


@F.pandas_udf(ArrayType(FloatType()))
def decode_vector(b: pd.Series) -> pd.Series:
    """Little-endian bytes as floats; a part of one at the end is dropped."""
    return b.map(lambda x: None if x is None else np.frombuffer(x, "<f4", len(x) // 4))
