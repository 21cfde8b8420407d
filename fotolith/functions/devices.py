"""Reports of devices and sizes as text: graphics cards, memory sizes, byte counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fotolith.functions.media import gpu_vendor

_GPU = "array<struct<vendor:string,name:string,vram_bytes:bigint,driver:string>>"
_MIB = 1024 * 1024


def _lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, "\r\n", "\n"), "\n")


def nvidia_gpus(report: Column) -> Column:
    """array<struct<vendor, name, vram_bytes, driver>> of a comma-separated report (name, MiB, driver) a line; lines
    without a name or a second field are left out."""
    cells = F.transform(_lines(report), lambda line: F.transform(F.split(line, ","), lambda c: F.trim(c)))
    known = F.filter(cells, lambda c: (F.size(c) >= 2) & (F.get(c, F.lit(0)) != ""))

    def card(c: Column) -> Column:
        vram = F.when(F.get(c, F.lit(1)).rlike(r"^[+]?[0-9]{1,12}$"), F.get(c, F.lit(1)).cast("long") * _MIB)
        return F.struct(F.lit("nvidia").alias("vendor"), F.get(c, F.lit(0)).alias("name"), vram.alias("vram_bytes"), F.nullif(F.get(c, F.lit(2)), F.lit("")).alias("driver"))

    return F.transform(known, card).cast(_GPU)


def memory_bytes(text: Column) -> Column:
    """Bytes of a size like "8 GB" or "1536 MB"; null for other units and texts."""
    number, unit = (F.regexp_extract(F.trim(text), r"^([0-9]*\.?[0-9]+|[0-9]+\.)\s+(\S+)", i) for i in (1, 2))
    short = F.regexp_replace(F.lower(unit), "b+$", "")
    scale = F.when(short == "g", 1024.0**3).when(short == "m", 1024.0**2).when(short == "k", 1024.0)
    return F.when(number != "", F.floor(number.cast("double") * scale).cast("long"))


def profiled_gpus(report: Column) -> Column:
    """The same of an indented report: a chipset line begins a card, memory lines after it belong to it."""
    trimmed = F.transform(_lines(report), lambda x: F.trim(x))
    begin = F.struct(F.array().cast(_GPU).alias("out"))

    def step(acc: Column, line: Column) -> Column:
        name = F.trim(F.regexp_extract(line, "^Chipset Model:(.*)$", 1))
        new = F.array(F.struct(gpu_vendor(name).alias("vendor"), name.alias("name"), F.lit(None).cast("long").alias("vram_bytes"), F.lit(None).cast("string").alias("driver"))).cast(_GPU)
        size = memory_bytes(F.regexp_extract(line, r"^VRAM \((?:Total|Dynamic, Max)\):(.*)$", 1))
        n = F.size(acc["out"])
        last = F.element_at(acc["out"], -1)
        sized = F.concat(F.slice(acc["out"], F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.struct(last["vendor"].alias("vendor"), last["name"].alias("name"), size.alias("vram_bytes"), last["driver"].alias("driver")))).cast(_GPU)
        out = F.when(line.startswith("Chipset Model:"), F.concat(acc["out"], new)).when(line.rlike(r"^VRAM \((?:Total|Dynamic, Max)\):") & (n > 0), sized).otherwise(acc["out"])
        return F.struct(out.alias("out"))

    return F.aggregate(trimmed, begin, step, lambda acc: acc["out"])


def size_text(n: Column) -> Column:
    """A byte count for people: two places from a gigabyte, whole megabytes and kilobytes below."""
    gb, mb, kb = 1e9, 1e6, 1e3
    return F.when(n >= gb, F.concat(F.format_string("%.2f", n / gb), F.lit(" GB"))).when(n >= mb, F.concat(F.format_string("%.0f", n / mb), F.lit(" MB"))).when(n >= kb, F.concat(F.format_string("%.0f", n / kb), F.lit(" KB"))).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def base64_text(data: Column) -> Column:
    """RFC 4648 with padding and without line breaks."""
    return F.regexp_replace(F.base64(data), r"[\r\n]", "")
