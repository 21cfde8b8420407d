"""Personal data: candidate gradient boosting, in DataFrame functions only.

Base spans are exact patterns with their checks (``base_spans``); they always stay. High-recall generators propose
further spans, overlapping ones too; each candidate has a few yes/no features of its format and its context, which
make up a small integer code. What tells a base span from a wider form of the same data ("@" or "(at)", the separators
of a card, the "+" of a phone) is no feature, so both share codes. The label is evidence that doesn't ask for the base
pattern: a common top-level domain or a cue word, the Luhn digit, a bracketed area code or a cue word. One aggregation
over all documents counts codes, evidence and base spans; at most kinds x 2^8 rows reach the driver, at any input
size. Boosted trees are fitted to that table there, and calibration picks, for each kind, the codes that are estimated
to have the wanted precision (``_estimate``). Scoring is a lookup of the code, so no Python runs on the executors and
nothing but the small counts is shuffled.

A candidate that can't be of its kind is neither counted nor added (``_POSSIBLE``). An address has four octets, so
each possible ip candidate is a base span and the method adds none.

Patterns are possessive and anchored by look-behinds, so they take time linear in the text, long runs of one character
class included. Offsets are code points, ends exclusive.

Defined results: a null text counts as empty and has no spans; redaction leaves it null. Repeated rows give a row each.
Ties at one start are ordered by kind as listed, then end. Extra columns pass through ``redact`` untouched. An empty
table gives an empty result, and nothing is learned from it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

_LOCAL = "[A-Za-z0-9._%+-]"
#: Leftmost non-overlapping matches of the base patterns. A start inside a run is looked for only where the last match
#: ended (\G), as elsewhere the start of the run would have matched first. Card and phone chains are matched whole with
#: their number of digits, which no other match can begin in; ip parts are checked afterwards.
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9](?:[ ().-]*+[0-9]){9,14}+(?![ ().-]*[0-9])",
}
#: Cheap tests without which a text can't hold a span of the kind.
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Generators: wider forms of the same data.
WIDE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++ ?+(?:@|[(\[] ?at ?[)\]]) ?+[A-Za-z0-9-]++(?: ?(?:\.|[(\[] ?dot ?[)\]]) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]++(?:\.[0-9]++){3,7}+",
    "card": r"(?<![0-9])(?<![0-9][ ./-])[0-9](?:[ ./-]?[0-9]){11,22}+(?![ ./-]?[0-9])",
    "phone": r"(?<![0-9A-Za-z.+])[+(]?[0-9](?:[ ().-]{0,2}+[0-9]){8,15}+(?![0-9])",
}
_BEFORE, _AFTER = 24, 4


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.transform(F.split(F.reverse(_digits(m)), ""), lambda c: F.try_to_number(c, F.lit("9")).cast("int"))
    twice = F.transform(d, lambda x, i: F.when(i % 2 == 0, x).otherwise(x * 2 - F.when(x > 4, 9).otherwise(0)))
    return F.aggregate(twice, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _octets(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.try_to_number(F.right(p, F.lit(3)), F.lit("999")).cast("int"), F.lit(0)) <= 255))


#: Whether a match of a base pattern is a base span, and whether a candidate is one.
_VALID: dict[str, Callable[[Column], Column]] = {"email": lambda m: F.lit(True), "ip": _octets, "card": _luhn, "phone": lambda m: F.lit(True)}


def _cue(words: str) -> Callable[[Column, Column, Column], Column]:
    return lambda m, b, a: b.rlike(rf"(?i)(?:{words})[^A-Za-z0-9]*$")


#: Yes/no features of a candidate (match, text before, text after), at most eight for each kind. None of them says
#: whether the candidate fits the base pattern, nor what its evidence is.
FEATURES: dict[str, list[Callable[[Column, Column, Column], Column]]] = {
    "email": [
        lambda m, b, a: m.rlike(r"(?<![A-Za-z0-9-])[A-Za-z]{2,8}$"),
        lambda m, b, a: m.rlike(r"[A-Za-z0-9-][.] "),
        lambda m, b, a: m.rlike(r"^[A-Za-z0-9]"),
        lambda m, b, a: m.rlike(r"^[0-9]++[^A-Za-z0-9._%+-]"),
        lambda m, b, a: a.rlike(r"^[@A-Za-z0-9]"),
    ],
    "ip": [
        lambda m, b, a: m.rlike(r"(?:^|\.)0[0-9]"),
        lambda m, b, a: b.rlike(r"[A-Za-z0-9_/-]$"),
        lambda m, b, a: a.rlike(r"^[A-Za-z0-9_-]"),
        _cue("version|release|section|v"),
        _cue("ip|address|host|server|from"),
    ],
    "card": [
        lambda m, b, a: F.length(_digits(m)) == 16,
        lambda m, b, a: m.rlike(r"^[0-9]+$"),
        lambda m, b, a: m.rlike(r"^[0-9]{4}([ ./-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}$|^[0-9]{4}([ ./-]?)[0-9]{6}\2[0-9]{5}$"),
        lambda m, b, a: m.rlike(r"^[3-6]"),
        lambda m, b, a: b.rlike(r"[A-Za-z0-9+.]$"),
        lambda m, b, a: a.rlike(r"^[A-Za-z]"),
        _cue("card|visa|pay|credit"),
    ],
    "phone": [
        lambda m, b, a: m.rlike(r"(?<![0-9])[0-9]{3}[ .-][0-9]{4}$"),
        lambda m, b, a: m.rlike(r"^[+]?[0-9]+$"),
        lambda m, b, a: m.rlike(r"[0-9]\.[0-9]+\.[0-9]"),
        lambda m, b, a: b.rlike(r"[#$/_-]$"),
        lambda m, b, a: a.rlike(r"^[A-Za-z0-9/]"),
        lambda m, b, a: m.rlike(r"[0-9]{7}"),
    ],
}

#: Common top-level domains that are no words.
_TOP = "com|org|net|edu|gov|mil|info|biz|io|dev|app|eu|uk|fr|ca|jp|cn|br|ru|pl|nl|ch"
#: Evidence that a candidate is of its kind, whether or not it fits the base pattern.
_EVIDENCE: dict[str, Callable[[Column, Column, Column], Column]] = {
    "email": lambda m, b, a: m.rlike(rf"(?i)[. )\]](?:{_TOP})$") | _cue(r"(?<![a-z])(?:e-?mail|contact|write|reach)(?: (?:me|us|to|at))*")(m, b, a),
    "ip": lambda m, b, a: _octets(m),
    "card": lambda m, b, a: _luhn(m),
    "phone": lambda m, b, a: m.rlike(r"[(][0-9]{2,4}[)]") | _cue(r"(?<![a-z])(?:phone|telephone|tel|call|mobile|fax)(?: (?:me|us|at|on))*")(m, b, a),
}
#: What a candidate of the kind must be in any form, besides the evidence where it is a check of the digits.
_POSSIBLE: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: m.rlike(r"[A-Za-z][A-Za-z0-9-]*$"),
    "ip": lambda m: (F.size(F.split(m, r"\.")) == 4) & _octets(m),
    "card": lambda m: F.length(_digits(m)).between(13, 19),
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}
#: Kinds whose evidence is a check that every true one passes: no candidate is added without it.
_CHECKED = ("card",)

_SPAN = "array<struct<s:int,k:int,e:int>>"
_CAND = "array<struct<s:int,k:int,e:int,code:int,base:boolean,evid:boolean>>"


def _walk(text: Column, pattern: str, kind: int, schema: str, made: Callable[[Column, Column, Column, Column, Column], Column]) -> Column:
    """Folds over the matches: the pieces between matches give the offsets."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    pairs = F.zip_with(pairs, F.slice(pieces, F.lit(2), F.size(found)), lambda x, after: F.struct(x["p"].alias("p"), x["m"].alias("m"), after.alias("a")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(schema).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["p"])
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.concat(acc["out"], made(s, e, x["m"], F.right(x["p"], F.lit(_BEFORE)), F.left(x["a"], F.lit(_AFTER))).cast(schema)).alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def base_spans(text: Column) -> Column:
    """array<struct<s, k, e>> of base spans, by start and kind."""
    every = []
    for k, kind in enumerate(KINDS):

        def made(s, e, m, b, a, k=k, kind=kind):
            return F.when(_VALID[kind](m), F.array(F.struct(s.alias("s"), F.lit(k).alias("k"), e.alias("e")))).otherwise(F.array().cast(_SPAN))

        maybe = F.contains(text, F.lit(_NEEDS[kind])) if _NEEDS[kind] else text.rlike("[0-9][ -]?[0-9]")
        every.append(F.when(maybe, _walk(text, BASE[kind], k, _SPAN, made)).otherwise(F.array().cast(_SPAN)))
    return F.array_sort(F.concat(*every))


def candidates(text: Column) -> Column:
    """array<struct<s, k, e, code, base, evid>> of the generators' spans that can be of their kind."""
    every = []
    for k, kind in enumerate(KINDS):

        def made(s, e, m, b, a, k=k, kind=kind):
            code = F.lit(0)
            for i, f in enumerate(FEATURES[kind]):
                code = code + F.when(f(m, b, a), 1 << i).otherwise(0)
            base = m.rlike(f"^(?:{BASE[kind]})$") & _VALID[kind](m)
            found = F.struct(s.alias("s"), F.lit(k).alias("k"), e.alias("e"), code.alias("code"), base.alias("base"), _EVIDENCE[kind](m, b, a).alias("evid"))
            return F.when(_POSSIBLE[kind](m), F.array(found)).otherwise(F.array().cast(_CAND))

        maybe = text.rlike("@|(?i:[(\\[] ?at)") if kind == "email" else text.rlike("[0-9][^A-Za-z]{1,3}[0-9]|[0-9]{9}")
        every.append(F.when(maybe, _walk(text, WIDE[kind], k, _CAND, made)).otherwise(F.array().cast(_CAND)))
    return F.concat(*every)


@dataclass(frozen=True)
class Model:
    """The codes of each kind that are redacted, with the score of every code seen."""

    chosen: tuple[frozenset[int], ...]
    scores: tuple[dict[int, float], ...]


def boost(codes: np.ndarray, yes: np.ndarray, no: np.ndarray, bits: int, rounds: int = 40, rate: float = 0.3, ridge: float = 1.0) -> np.ndarray:
    """Scores of codes by gradient-boosted trees of depth two over their bits, fitted to weighted counts."""
    x = (codes[:, None] >> np.arange(bits)) & 1
    weight = yes + no
    margin = np.zeros(len(codes))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * p - yes, weight * p * (1 - p)
        best, gain = None, 1e-9
        for i in range(bits):
            for j in range(i, bits):
                leaf = x[:, i] * 2 + x[:, j]
                gs, hs = np.bincount(leaf, g, 4), np.bincount(leaf, h, 4)
                if (now := float((gs**2 / (hs + ridge)).sum())) > gain:
                    best, gain = (leaf, -gs / (hs + ridge)), now
        if best is None:
            break
        margin += rate * best[1][best[0]]
    return 1 / (1 + np.exp(-margin))


def _estimate(kind: str, yes: np.ndarray, no: np.ndarray, base: np.ndarray, seen: float) -> tuple[np.ndarray, np.ndarray]:
    """For each code, how many candidates a choice of it redacts and how many of these are estimated to be true.

    Where evidence is a check, only candidates that pass are redacted, and the limit on the score keeps out formats that
    mostly fail it, which pass by chance. Elsewhere true ones show evidence as often as base spans do (``seen``)."""
    if kind in _CHECKED:
        return yes, yes
    return yes + no, np.minimum(np.maximum(yes / seen, base), yes + no)


def fit(docs: DataFrame, text: str = "text", precision: float = 0.98) -> Model:
    """Fits and calibrates on the counts of all documents' candidates."""
    found = docs.select(F.explode(candidates(F.coalesce(F.col(f"`{text}`"), F.lit("")))).alias("c"))
    counts = found.groupBy("c.k", "c.code").agg(F.count_if(F.col("c.evid")).alias("yes"), F.count_if(~F.col("c.evid")).alias("no"), F.count_if(F.col("c.base")).alias("base"), F.count_if(F.col("c.base") & F.col("c.evid")).alias("both"))
    rows = counts.collect()  # at most 2^8 codes for each of four kinds
    chosen, scores = [], []
    for k, kind in enumerate(KINDS):
        own = sorted((r.code, r.yes, r.no, r.base, r.both) for r in rows if r.k == k)
        if not own:
            chosen.append(frozenset())
            scores.append({})
            continue
        codes, yes, no, base, both = (np.array(c) for c in zip(*own, strict=True))
        seen = (both.sum() + 1) / (base.sum() + 1)
        score = boost(codes, yes.astype(float), no.astype(float), len(FEATURES[kind]))
        hits, true = _estimate(kind, yes, no, base, seen)
        order = np.argsort(-score, kind="stable")
        reached = np.cumsum(true[order]) >= precision * np.cumsum(hits[order])
        most = int(np.flatnonzero(reached)[-1]) + 1 if reached.any() else 0
        limit = max(0.5 * seen, score[order[most - 1]]) if most else 2.0
        chosen.append(frozenset(codes[score >= limit].tolist()))
        scores.append(dict(zip(codes.tolist(), score.tolist(), strict=True)))
    return Model(tuple(chosen), tuple(scores))


def all_spans(text: Column, base: Column, model: Model) -> Column:
    """Base spans and the chosen candidates that overlap none of them."""
    if not any(model.chosen):
        return base

    def wanted(c: Column) -> Column:
        fits = F.lit(False)
        for k, codes in enumerate(model.chosen):
            if codes:
                own = (c["k"] == k) & c["code"].isin(*sorted(codes))
                fits = fits | (own & c["evid"] if KINDS[k] in _CHECKED else own)
        return fits & ~c["base"] & ~F.exists(base, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))

    more = F.transform(F.filter(candidates(text), wanted), lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e")))
    return F.array_sort(F.concat(base, more))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))))


def _count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["k"] == kind)).cast("long")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans of each row."""
    model = model or fit(docs, text)
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`"), t.alias("__t")).withColumn("__base", base_spans(F.col("__t")))
    rows = rows.withColumn("__all", all_spans(F.col("__t"), F.col("__base"), model))
    counts = [_count(F.col("__base"), k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return rows.select(F.col(f"`{key}`"), *counts, F.sha2(_joined(F.col("__base")), 256).alias("base_sha256"), _joined(F.col("__all")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", model: Model | None = None) -> DataFrame:
    """The rows with every span replaced by <EMAIL>, <IP>, <CARD> or <PHONE>; overlapping spans give one mark."""
    model = model or fit(docs, text)
    columns = docs.columns
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.withColumn("__base", base_spans(t))
    rows = rows.withColumn("__all", all_spans(t, F.col("__base"), model))
    marks = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))

    def step(acc: Column, x: Column) -> Column:
        fresh = x["s"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], F.substring(t, acc["at"] + 1, x["s"] - acc["at"]), F.element_at(marks, x["k"] + 1))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    new = F.aggregate("__all", start, step, lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t))))
    return rows.withColumn(text, F.when(F.size("__all") > 0, new).otherwise(F.col(f"`{text}`"))).select(*(F.col(f"`{c}`") for c in columns))
