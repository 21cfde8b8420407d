"""URL filter: host and path rules, then a character language-model ratio, in DataFrame functions only.

Rules decide what they fit. Their decisions are the training text of two smoothed variable-order Markov models, one of
accepted and one of rejected URLs: character counts in contexts of up to ``order`` characters, interpolated from the
longest context seen down to the uniform distribution (Witten-Bell). They read the whole URL, scheme, query and fragment
included, with the case of scheme and host ignored; only the rules look at host and path alone. The score of a URL is
the difference of its two log-likelihoods per character. The threshold is calibrated on a fifth of the decided URLs,
which the models don't see, as the point between both means weighted by their spread.

Everything is counted over all rows. Equal URLs are one row with a weight; n-grams are combined before the shuffle, and
contexts meet their counts in equi joins. Broadcast are the counts of single characters and the ratios of the ``COMMON``
commonest grams, both of bounded size, and what the planner measures as small.

Defined results: no "://" or a null URL gives empty host and path, no rule, and the score of empty text, 0. Ties at the
threshold allow. With no decided URL on one side nothing can be learned: scores and the threshold are 0, which allows.
Repeated rows give a row each. Very long URLs are read whole, in time and shuffled bytes in proportion to their length.
Columns of the input other than the two named are not read. Empty tables give empty results.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotolith.llm.scratch import Scratch

#: How many of the commonest grams have their ratios broadcast.
COMMON = 1000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Fits its host and all subdomains where the path starts with the rule's."""

    allow: bool
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the contract: verdict, host, path.
RULES = (
    Rule(True, "org", "/"),
    Rule(False, "example.org", "/es/"),
    Rule(False, "example.org", "/en/1"),
    Rule(True, "com", "/fr/"),
    Rule(False, "com", "/de/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def whole(url: Column) -> Column:
    """The whole URL as the models read it: scheme and host in lower case; empty without "://"."""
    parts = [F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)(.*)$", i) for i in (1, 2)]
    return F.coalesce(F.concat(F.translate(parts[0], _UPPER, _LOWER), parts[1]), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The number of the longest rule that fits, or null."""
    out = None
    for i in sorted(range(len(rules)), key=lambda i: (-len(rules[i].text), i)):
        r = rules[i]
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, i) if out is None else out.when(fits, i)
    return out if out is not None else F.lit(None).cast("int")


def _grams(urls: DataFrame, order: int, *keep: str) -> DataFrame:
    """The columns ``keep``, gram (``order`` characters and the one after them) for each place of the
    URL, which is padded in front. Characters are split once, as taking each substring would count from the front."""
    padded = F.concat(F.lit("\x02" * order), F.col("body"), F.lit("\x03"))
    chars = F.regexp_extract_all(padded, F.lit("(?s)."), F.lit(0))
    split = urls.select(*keep, chars.alias("__chars"))
    own = F.transform(F.sequence(F.lit(1), F.size("__chars") - order), lambda i: F.array_join(F.slice("__chars", i, F.lit(order + 1)), ""))
    return split.select(*keep, F.explode(own).alias("gram"))


def _model(decided: DataFrame, order: int) -> DataFrame:
    """(gram of order + 1 characters, yes, no): counts in accepted and rejected URLs."""
    return _grams(decided, order, "allow", "weight").groupBy("gram").agg(F.sum(F.when(F.col("allow"), F.col("weight")).otherwise(0)).alias("yes"), F.sum(F.when(~F.col("allow"), F.col("weight")).otherwise(0)).alias("no"))


def _ratios(grams: DataFrame, model: DataFrame, order: int, alphabet: int) -> DataFrame:
    """(gram, ratio): the log of the two models' probabilities of a gram's last character after the rest.

    All context lengths are looked up together: a gram's ends meet the counts of ends, and what stands before their last
    characters meets the counts of contexts, in one join each. The empty context would be one key of all rows; its one
    row is broadcast, as are the counts of single characters, of which there are 1,114,112 at the most."""
    ends = F.transform(F.sequence(F.lit(1), F.lit(order + 1)), lambda k: F.right("gram", k))
    seen = model.select(F.explode(ends).alias("g"), "yes", "no").groupBy("g").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    context = F.left("g", F.length("g") - 1).alias("c")
    sums = [f(c).alias(f"{n}_{c}") for c in ("yes", "no") for n, f in (("total", F.sum), ("kinds", lambda c: F.count_if(F.col(c) > 0)))]
    names = [f"{n}{c}" for c in ("yes", "no") for n in ("", "total_", "kinds_")]
    single = seen.where(F.length("g") == 1)
    every = single.agg(*sums)  # one row
    wide = grams.select("gram", F.right("gram", F.lit(1)).alias("g")).join(F.broadcast(single), "g", "left").crossJoin(F.broadcast(every)).select("gram", *(F.col(n).alias(f"{n}0") for n in names))
    if order:
        longer = seen.where(F.length("g") > 1)
        keys = grams.select("gram", F.posexplode(F.slice(ends, 2, order)).alias("k", "g")).select("gram", (F.col("k") + 1).alias("k"), "g", context)
        found = keys.join(longer, "g", "left").join(longer.groupBy(context).agg(*sums), "c", "left")
        more = found.groupBy("gram").agg(*(F.max(F.when(F.col("k") == k, F.col(n))).alias(f"{n}{k}") for k in range(1, order + 1) for n in names))
        wide = wide.join(more, "gram")
    p = {}
    for c in ("yes", "no"):
        p[c] = F.lit(1.0 / alphabet)
        for k in range(order + 1):
            total, kinds = F.coalesce(f"total_{c}{k}", F.lit(0)), F.coalesce(f"kinds_{c}{k}", F.lit(0))
            p[c] = F.when(total > 0, (F.coalesce(f"{c}{k}", F.lit(0)) + kinds * p[c]) / (total + kinds)).otherwise(p[c])
    return wide.select("gram", (F.log(p["yes"]) - F.log(p["no"])).alias("ratio"))


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules: tuple[Rule, ...] = RULES, order: int = 4, alphabet: int = 256, fold: int = 5) -> DataFrame:
    """key, host, path, rule, verdict, score and threshold of each row."""
    s = Scratch(pages.sparkSession)
    u = F.col(f"`{url}`")
    host, path = host_and_path(u)
    rows = pages.select(F.col(f"`{key}`"), u.alias("__url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumns({"__rule": rule_of(F.col("host"), F.col("path"), rules), "body": whole(F.col("__url"))})
    urls = rows.groupBy("body").agg(F.count("*").alias("weight"), F.min("__rule").alias("rule"))
    verdicts = F.array(*(F.lit(r.allow) for r in rules)) if rules else F.array().cast("array<boolean>")
    urls = urls.withColumns({"allow": F.get(verdicts, F.col("rule")), "held": F.pmod(F.xxhash64("body"), F.lit(fold)) == 0})
    urls = s.write(urls, "urls")
    decided = urls.where("allow is not null and body != ''")
    model = s.write(_model(decided.where("not held"), order), "model")
    # a URL's grams carry 128 bits of its digest instead of the URL, so a long one costs no more a character
    own = F.substring(F.sha2("body", 256), 1, 32).alias("own")
    grams = s.write(_grams(urls.where("body != ''").select(own, "body"), order, "own"), "grams")
    known = s.write(grams.groupBy("gram").agg(F.count("*").alias("places")), "known")
    ratios = s.write(_ratios(known.select("gram"), model, order, alphabet), "ratios")
    # the commonest grams ("http" at the front) would each send a row of every URL to one task: their ratios go to the rows
    common = known.orderBy(F.desc("places"), "gram").limit(COMMON).join(ratios, "gram").select("gram", F.col("ratio").alias("common"))
    marked = grams.join(F.broadcast(common), "gram", "left")
    sums = [F.sum("ratio").alias("total"), F.count("*").alias("places")]
    near = marked.where("common is not null").withColumnRenamed("common", "ratio").groupBy("own").agg(*sums)
    far = marked.where("common is null").join(ratios, "gram").groupBy("own").agg(*sums)
    scores = near.union(far).groupBy("own").agg((F.sum("total") / F.sum("places")).alias("score"))
    scores = s.write(urls.select("body", "allow", "held", "weight", own).join(scores, "own", "left").withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 9)).drop("own"), "scores")
    s.drop("urls", "model", "grams", "known", "ratios")
    limit, trained = _calibrated(scores)
    scored = scores.select("body", F.when(F.lit(trained), F.col("score")).otherwise(0.0).alias("score"))
    names = F.array(*(F.lit(r.text) for r in rules)) if rules else F.array().cast("array<string>")
    said = F.coalesce(F.get(verdicts, F.col("__rule")), F.col("score") >= limit)
    out = rows.join(scored, "body").select(f"`{key}`", "host", "path", F.get(names, F.col("__rule")).alias("rule"), F.when(said, "allow").otherwise("block").alias("verdict"), "score", F.lit(limit).alias("threshold"))
    return out


def _calibrated(scores: DataFrame) -> tuple[float, bool]:
    """The threshold from one row of sums, and whether both models could be trained."""
    w, x = F.col("weight"), F.col("score")
    aggs = []
    for side, of in (("yes", F.col("allow")), ("no", ~F.col("allow"))):
        for part, held in (("held", F.col("held")), ("train", ~F.col("held"))):
            own = of & held
            aggs += [F.sum(F.when(own, y)).alias(f"{side}_{part}_{n}") for n, y in (("n", w), ("s", w * x), ("q", w * x * x))]
    r = scores.where("allow is not null and body != ''").agg(*aggs).first()
    stats = []
    for side in ("yes", "no"):
        if not r[f"{side}_train_n"]:
            return 0.0, False
        part = "held" if r[f"{side}_held_n"] else "train"
        n, total, square = (float(r[f"{side}_{part}_{x}"]) for x in "nsq")
        mean = total / n
        stats.append((mean, math.sqrt(max(square / n - mean * mean, 0.0)) + 1e-9))
    (m1, d1), (m0, d0) = stats
    return round((m1 * d0 + m0 * d1) / (d0 + d1), 9), True
