"""URL filter, token counts, chats, pieces, classifier, pipeline."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fotolith.llm import chat_format, pieces, quality_classifier, token_counts, url_filter
from fotolith.llm.queries import QUERIES

PIECES = pieces.DEFAULT_MODEL


# URLs


def test_rules_and_parts(spark):
    urls = ["HTTP://WWW.Example.org/es/1?x", "https://a.example.org/en/12", "https://example.org/en/2", "http://x.com/fr/1#t", "http://x.com/de/1", "http://x.net/a", "no scheme", None, "http://org", "http://badorg/x", "ftp://y.org?q=/es/", "http://x.com/free", "http://x.com/fr", "http://x.com/frauds/fr/"]
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule) for r in url_filter.judge(df).collect()}
    assert got == {
        0: ("www.example.org", "/es/1", "example.org/es/"),
        1: ("a.example.org", "/en/12", "example.org/en/1"),
        2: ("example.org", "/en/2", "org/"),
        3: ("x.com", "/fr/1", "com/fr/"),
        4: ("x.com", "/de/1", "com/de/"),
        5: ("x.net", "/a", None),
        6: ("", "", None),
        7: ("", "", None),
        8: ("org", "", None),
        9: ("badorg", "/x", None),
        10: ("y.org", "", None),
        11: ("x.com", "/free", None),
        12: ("x.com", "/fr", None),
        13: ("x.com", "/frauds/fr/", None),
    }
    assert url_filter.judge(df.where("false")).count() == 0


def test_markov_ratio(spark):
    rng = random.Random(2)
    bodies = ["".join(rng.choice("abc/") for _ in range(rng.randint(1, 9))) for _ in range(40)]
    order, alphabet = 3, 256
    rows = [(b, rng.randint(1, 3), rng.random() < 0.5) for b in sorted(set(bodies))]
    train = spark.createDataFrame(rows[: len(rows) // 2], "body string, weight long, allow boolean")
    model = url_filter._model(train, order)
    grams = url_filter._grams(spark.createDataFrame([(r[0],) for r in rows], "body string"), order).select("gram").distinct()
    got = {r.gram: r.ratio for r in url_filter._ratios(grams, model, order, alphabet).collect()}
    counts = {True: Counter(), False: Counter()}
    for b, w, allow in rows[: len(rows) // 2]:
        t = "\x02" * order + b + "\x03"
        for i in range(len(b) + 1):
            counts[allow][t[i : i + order + 1]] += w

    def p(side, gram):
        out = 1 / alphabet
        for k in range(order + 1):
            c, ch = gram[order - k : order], gram[-1]
            follow = defaultdict(int)
            for g, n in counts[side].items():
                if g[order - k : order] == c:
                    follow[g[-1]] += n
            if follow:
                out = (follow[ch] + len([x for x in follow if follow[x]]) * out) / (sum(follow.values()) + len([x for x in follow if follow[x]]))
        return out

    for gram, ratio in got.items():
        assert math.isclose(ratio, math.log(p(True, gram)) - math.log(p(False, gram)), abs_tol=1e-9)


def test_method_learns_from_rules(spark):
    rows = [(i, f"http://{'good' if i % 2 else 'junk'}{i}.{'org' if i % 2 else 'com'}/{'a' if i % 2 else 'de'}/{'good' if i % 2 else 'junk'}{i}") for i in range(200)]
    rows += [(1000, "http://good7.net/good9"), (1001, "http://junk8.net/junk3"), (1002, "http://good7.net/good9")]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert (got[1000].verdict, got[1001].verdict, got[1002].verdict) == ("allow", "block", "allow")
    assert got[1000].score == got[1002].score and got[1].verdict == "allow" and got[2].verdict == "block"


def brute_judge(urls, order=4, alphabet=256):
    """Rules, models, calibration and verdicts without Spark, the fold of a URL given by the caller."""
    rules = [(True, "org", "/"), (False, "example.org", "/es/"), (False, "example.org", "/en/1"), (True, "com", "/fr/"), (False, "com", "/de/")]
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    parts = {}
    for u in urls:
        m = re.match(r"(?s)(.*?://)([^/?#]*)([^?#]*)(.*)$", u or "")
        host, path = (lower(m[2]), m[3]) if m else ("", "")
        fits = [(len(h + p), -i, i) for i, (_, h, p) in enumerate(rules) if (host == h or host.endswith("." + h)) and path.startswith(p)]
        parts[u] = host, path, max(fits)[2] if fits else None, lower(m[1] + m[2]) + m[3] + m[4] if m else ""
    return rules, parts


def test_judging_against_brute_force(spark):
    rng = random.Random(9)
    word = lambda abc: "".join(rng.choice(abc) for _ in range(rng.randint(2, 7)))
    urls = [f"http://{word('abc')}.org/{word('abcd')}" for _ in range(60)] + [f"https://{word('xyz')}.com/de/{word('xyzw')}" for _ in range(60)]
    urls += [f"{start}{word(abc)}.net/{way}{word(abc)}?q={word(abc)}" for start, way, abc in (("http://", "", "abcd"), ("https://", "de/", "xyzw"), ("http://", "", "abxy")) for _ in range(20)] + [None, "none", "http://a.COM/fr/é#x", urls[3], urls[3], urls[70]]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    rules, parts = brute_judge(urls)
    folds = {r.body: r.held for r in spark.createDataFrame([(p[3],) for p in parts.values()], "body string").distinct().select("body", (F.pmod(F.xxhash64("body"), F.lit(5)) == 0).alias("held")).collect()}
    weight = Counter(parts[u][3] for u in urls)
    allow = {p[3]: rules[p[2]][0] for p in parts.values() if p[2] is not None}
    counts = {True: Counter(), False: Counter()}
    grams = lambda b: [("\x02" * 4 + b + "\x03")[i : i + 5] for i in range(len(b) + 1)]
    for b, side in allow.items():
        if b and not folds[b]:
            for g in grams(b):
                counts[side][g] += weight[b]

    after = {side: defaultdict(Counter) for side in counts}
    for side, own in counts.items():
        for g, n in own.items():
            for k in range(5):
                after[side][g[4 - k : 4]][g[4]] += n

    def p(side, gram):
        out = 1 / 256
        for k in range(5):
            seen = after[side].get(gram[4 - k : 4], Counter())
            total, kinds = sum(seen.values()), len(seen)
            out = (seen[gram[4]] + kinds * out) / (total + kinds) if total else out
        return out

    memo = {}
    ratio = lambda g: memo.setdefault(g, math.log(p(True, g)) - math.log(p(False, g)))
    score = {b: sum(map(ratio, grams(b))) / (len(b) + 1) if b else 0.0 for b in folds}
    stats = []
    for side in (True, False):
        own = [(score[b], weight[b]) for b, a in allow.items() if a == side and b and folds[b]]
        n = sum(w for _, w in own)
        mean = sum(x * w for x, w in own) / n
        stats.append((mean, math.sqrt(max(sum(x * x * w for x, w in own) / n - mean * mean, 0))))
    (m1, d1), (m0, d0) = stats
    limit = (m1 * d0 + m0 * d1) / (d0 + d1)
    for i, u in enumerate(urls):
        host, path, rule, body = parts[u]
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, None if rule is None else rules[rule][1] + rules[rule][2])
        assert abs(got[i].score - score[body]) < 1e-6 and abs(got[i].threshold - limit) < 1e-6
        said = rules[rule][0] if rule is not None else got[i].score >= got[i].threshold
        assert got[i].verdict == ("allow" if said else "block")
    assert {got[i].verdict for i, u in enumerate(urls) if parts[u][2] is None} == {"allow", "block"}


def test_a_very_long_url_takes_time_in_proportion(spark):
    long = "http://x.net/" + "ab/" * 20000
    rows = [(0, long), (1, "http://a.org/x"), (2, "http://a.com/de/y")]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert len(got[0].path) == 60001 and got[1].verdict == "allow" and got[2].verdict == "block"


# token counts


def test_rollup(spark, tmp_path):
    roll = token_counts.Rollup(spark, f"file://{tmp_path}/r")
    rows = spark.createDataFrame([("a", "en", 3), ("a", "en", 4), (None, "de", 5)], "source string, lang string, tokens long")
    assert roll.totals().count() == 0
    assert roll.commit("b1", token_counts.inserts(rows, "v1"))
    assert not roll.commit("b1", token_counts.inserts(rows, "v1"))
    want = {("a", "en", "v1", 2, 7), (None, "de", "v1", 1, 5)}
    assert {tuple(r) for r in roll.totals().collect()} == want
    roll.commit("gone/1", token_counts.deletes(rows.where("tokens = 4"), "v1"))
    roll.commit("new", token_counts.revisions(rows.where("tokens = 5"), "v1", rows.where("tokens = 5").withColumn("tokens", F.lit(9)), "v2"))
    want = {("a", "en", "v1", 1, 3), (None, "de", "v2", 1, 9)}
    assert {tuple(r) for r in roll.totals().collect()} == want
    roll.compact()
    assert {tuple(r) for r in roll.totals().collect()} == want
    assert not roll.commit("gone/1", token_counts.inserts(rows, "v1"))
    assert all(map(roll.committed, ("b1", "gone/1", "new"))) and not roll.committed("empty")
    roll.commit("empty", token_counts.inserts(rows.where("false"), "v1"))
    assert {tuple(r) for r in roll.totals().collect()} == want


def test_compaction_may_die_anywhere(spark, tmp_path, monkeypatch):
    roll = token_counts.Rollup(spark, f"file://{tmp_path}/r")
    rows = spark.createDataFrame([("a", "en", 3)], "source string, lang string, tokens long")
    for k in range(3):
        roll.commit(f"b{k}", token_counts.inserts(rows, "v"))
    want = [("a", "en", "v", 3, 9)]
    totals = lambda: [tuple(r) for r in roll.totals().collect()]
    sweep = token_counts.Rollup._sweep
    monkeypatch.setattr(token_counts.Rollup, "_sweep", lambda self: None)  # died before the old folders went
    assert roll.compact() and totals() == want and len(roll._folders()) == 4
    assert not roll.commit("b1", token_counts.inserts(rows, "v"))
    monkeypatch.setattr(token_counts.Rollup, "_publish", lambda self, staged, name: (_ for _ in ()).throw(OSError("died")))
    with pytest.raises(OSError):
        roll._folders() and roll.commit("late", token_counts.inserts(rows, "v"))
    monkeypatch.undo()
    assert token_counts.Rollup._sweep is sweep
    assert roll.commit("late", token_counts.inserts(rows, "v")) and roll.compact()
    assert totals() == [("a", "en", "v", 4, 12)] and len(roll._folders()) == 1
    assert all(not roll.commit(b, token_counts.inserts(rows, "v")) for b in ("b0", "b1", "b2", "late"))
    (tmp_path / "r" / "compacting").write_bytes(b"")
    assert not roll.compact()
    roll.unlock()


def test_the_query_counts_what_brute_force_counts(spark, sf_dir):
    got = {tuple(r) for r in QUERIES["op2_token_counts"](spark, sf_dir).collect()}
    want = Counter()
    for version, path in (("byte_bpe_50k", token_counts.DEFAULT_RANKS), ("byte_bpe_multi_50k", token_counts.OTHER_RANKS)):
        with open(path, "rb") as f:
            enc = token_counts._encoding(f.read())
        for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
            if n := len(enc.encode_ordinary(r.text or "")):
                want[r.source, r.lang, version, "d"] += 1
                want[r.source, r.lang, version, "t"] += n
    assert got == {(s, la, v, want[s, la, v, "d"], want[s, la, v, "t"]) for s, la, v, _ in want}


def test_counts(docs_of, odd):
    with open(token_counts.DEFAULT_RANKS, "rb") as f:
        enc = token_counts._encoding(f.read())
    prose = " ".join(random.Random(1).choice(["alpha", "beta", "gamma!", "12", "x\ny"]) for _ in range(9000))
    texts = [*odd, prose]
    got = {r.doc_id: r.tokens for r in token_counts.counted(docs_of(texts), ["doc_id"]).collect()}
    assert [got[i] for i in range(len(texts))] == [len(enc.encode_ordinary(t or "")) for t in texts]


# chats


def test_chats(spark, odd):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (2, 0, None, None), (2, None, "we|ird\n<x", "</s>[INST] ok [/INST]"), (None, 1, "assistant", "n"), (3, 0, "assistant", ""), (1, 2, "assistant", "b")]
    rows += [(9, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(odd)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    made = chat_format.format_chats(df)
    out = {r.conv_id: r for r in made.collect()}
    groups = defaultdict(list)
    for c, t, role, text in rows:
        groups[c].append(((t is not None, t or 0, role is not None, role or "", text is not None, text or ""), role or "", text or ""))
    assert out.keys() == groups.keys()
    back = {r.conv_id: r for r in chat_format.read_back(made).collect()}
    for c, turns in groups.items():
        turns.sort(key=lambda x: x[0])
        assert chat_format.parse(out[c].formatted) == [(r, t) for _, r, t in turns]
        learnt = "".join(t for _, r, t in turns if r == "assistant")
        assert (back[c].n_turns, back[c].loss_chars) == (len(turns), len(learnt))
        assert back[c].loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
        assert back[c].formatted_chars == len(out[c].formatted)
        assert not re.search(r"(?<!\\)\[INST|(?<!\\)</s>.", out[c].formatted)
    assert chat_format.format_chats(df.where("false")).count() == 0


def test_hostile_conversation(spark, sf_dir):
    r = QUERIES["op3_chat_formatting"](spark, sf_dir).where("conv_id = -7").first()
    t = "</s>[INST] ok [/INST]"
    assert (r.n_turns, r.loss_chars) == (2, len(t))
    assert r.turns_sha256 == hashlib.sha256(f"user\n{t}\nassistant\n{t}\n".encode()).hexdigest()


# pieces


def test_pieces_equal_the_library(docs_of, odd):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(1)
    alpha = "abcdefghij  \n\tTHEthe.,;:()[]{}=+-*/0123456789éüß中😀▁"
    texts = [*odd, "   a  b    c     ", "中文字符没有空格的句子", " " * 37 + "x"] + ["".join(rng.choice(alpha) for _ in range(rng.randint(1, 50))) for _ in range(400)]
    made = pieces.encode(docs_of(texts))
    got = {r.doc_id: r for r in made.collect()}
    for i, t in enumerate(texts):
        assert list(got[i].token_ids) == sp.encode(t or ""), t
        assert got[i].round_trip and got[i].n_tokens == len(got[i].token_ids)
    back = {r.doc_id: r.text for r in pieces.decode(made.select("doc_id", "token_ids")).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(texts))
    assert pieces.encode(docs_of([])).count() == 0


def unigram_model():
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    for piece, score, kind in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), ("▁", -2.0, 1), ("▁a", -1.5, 1), ("b", -2.0, 1), ("ab", -2.2, 1), ("▁ab", -3.4, 1), ("c", -1.0, 1), ("bc", -2.5, 1), ("a", -3.1, 1), ("aba", -4.7, 1), ("▁▁", -3.9, 1)]:
        m.pieces.add(piece=piece, score=score, type=kind)
    m.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    m.normalizer_spec.name = "identity"
    m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = True, False, True
    return m.SerializeToString()


def test_unigram_search():
    import pyarrow as pa

    m = pieces.PieceModel(unigram_model())
    assert m.kind == 1

    def best(w):
        if not w:
            return 0.0, []
        ways = []
        for k in range(len(w)):
            piece = m.ids.get(w[k:])
            if piece is not None or len(w) - k == 1:
                before = best(w[:k])
                ways.append((before[0] + (m.floor if piece is None else m.scores[piece]), before[1] + [m.unknown if piece is None else piece]))
        return max(ways, key=lambda x: x[0])

    rng = random.Random(3)
    texts = ["abc ab abbc xc aba b", "", "  a"] + ["".join(rng.choice("abcx ") for _ in range(rng.randint(1, 20))) for _ in range(200)]
    ids, bounds = m.encode(pa.array(texts))
    for i, t in enumerate(texts):
        words = re.findall("▁+[^▁]*", "▁" + t.replace(" ", "▁")) if t else []
        assert ids[bounds[i] : bounds[i + 1]].tolist() == [x for w in words for x in best(w)[1]], t


def test_forgetting_changes_nothing(monkeypatch):
    import pyarrow as pa

    rng = random.Random(6)
    texts = ["".join(rng.choice("the an ing  éß日 123\n.,#") for _ in range(60)) for _ in range(60)]
    with open(PIECES, "rb") as f:
        raw = f.read()
    ids, _ = pieces.PieceModel(raw).encode(pa.array(texts))
    for name in ("CACHE", "BORDERS", "STEPS"):
        monkeypatch.setattr(pieces, name, 5)
    m = pieces.PieceModel(raw)
    assert [x for t in texts for x in m.encode(pa.array([t]))[0].tolist()] == ids.tolist()


# classifier


def test_classifier_on_held_out(spark, sf_dir):
    got = QUERIES["op8_quality_classifier"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out").collect()
    assert got and sum(r.predicted == r.quality for r in got) >= 0.9 * len(got)


def test_voting_against_brute_force(spark, sf_dir):
    import numpy as np
    import pyarrow as pa

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), None, quality_classifier.Settings(sample=60, neighbours=7))
    texts = [r.text for r in docs.orderBy("doc_id").limit(40).collect()]
    texts += [texts[0], "", "zzz"]
    got = model.score(pa.array(texts))
    for t, score in zip(texts, got):
        x = (quality_classifier.features(pa.array([t]))[0] * model.weights) @ model.axes
        x = x / max(float(np.linalg.norm(x)), 1e-9)
        near = sorted(((-float(x @ v), k) for k, v in enumerate(model.vectors)))[:7]
        votes = [(max(-s, 0.0) ** 2, model.labels[k]) for s, k in near]
        total = sum(v for v, _ in votes)
        want = sum(v * y for v, y in votes) / total if total else model.prior
        assert abs(want - score) < 1e-4, t
    assert 0 < len(model.labels) <= 60 and len(set(model.labels)) == 2


def test_classifier_odd_cases(spark, docs_of, odd):
    docs = docs_of(odd)
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (5, None, 0), (6, 7, 0), (99, 1, 0), (None, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality_classifier.train(docs, labels)
    scores = [r.score for r in quality_classifier.score(docs, model, ["doc_id"]).collect()]
    assert len(scores) == len(odd) and all(0 <= x <= 1 for x in scores)
    none = quality_classifier.train(docs, labels.where("false"))
    assert {r.score for r in quality_classifier.score(docs, none, ["doc_id"]).collect()} == {0.5}
    assert quality_classifier.score(docs_of([]), model, ["doc_id"]).count() == 0


# pipeline


def test_pipeline(spark, sf_dir):
    import sentencepiece

    from tests.llm.test_text_operators import brute_components, brute_pii, brute_windows

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out, frames = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, sf_dir).checkpoint()
        frames[name] = out
        if name != "sentencepiece":
            assert out.columns == docs.columns
    one = [tuple(r) for r in frames["quality_rules"].select("doc_id", "text").collect()]
    comps = brute_components([r[0] for r in one], [r[1] for r in one])
    assert {r.doc_id for r in frames["jaccard_join"].collect()} == {d for d, _, c in comps if d == c}
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    before = {r.doc_id: r.text for r in frames["jaccard_join"].collect()}
    after = {r.doc_id: r.text for r in frames["decontamination"].collect()}
    hits = dict(zip(before, brute_windows(before.values(), items)))
    assert all(after.get(d) == before[d] for d in before if not hits[d][1])
    assert all(not h[1] for h in brute_windows(after.values(), items)) and any(h[1] for h in hits.values())
    private = {r.doc_id: r for r in frames["pii"].collect()}
    assert private.keys() == after.keys()
    assert all((private[d].text == t) == (not brute_pii(t)) for d, t in after.items())
    assert all(r.n_chars == len(r.text) for r in private.values())
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    final = {r.doc_id: list(r.token_ids) for r in out.collect()}
    assert final == {d: sp.encode(r.text) for d, r in private.items()}


def test_pipeline_of_nothing(spark, docs_of, tmp_path):
    docs_of([None, ""]).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
