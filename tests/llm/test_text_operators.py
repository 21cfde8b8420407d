"""Operators on single texts and on pairs, against brute force and SQL."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import pytest

from fotolith.llm import decontamination, jaccard_join, pii, quality_rules, repeats
from fotolith.llm.queries import ORACLE_SQL, QUERIES

TABLES = "documents pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(name, spark, sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    df = QUERIES[name](spark, sf_dir)
    got = c.execute(ORACLE_SQL[name])
    names = [x[0] for x in got.description]
    columns = sorted(df.columns)
    assert sorted(names) == columns
    assert sorted(tuple(str(r[x]) for x in columns) for r in df.collect()) == sorted(tuple(str(r[names.index(x)]) for x in columns) for r in got.fetchall())


def test_quality_rules_on_odd_texts(docs_of, odd):
    got = {r.doc_id: r for r in quality_rules.annotate(docs_of(odd)).collect()}
    assert len(got) == len(odd)
    for i, t in enumerate(odd):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        hit = {k + j for k in range(len(words) - 4) if grams[tuple(words[k : k + 5])] > 1 for j in range(5)}
        assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words) == (len(words), sum(map(len, words)), len(hit)), i
        assert not got[i].kept or not got[i].base_failed
    assert quality_rules.keep_good(docs_of(odd)).columns == docs_of(odd).columns
    assert quality_rules.annotate(docs_of([])).count() == 0


def test_quality_rules_keep_prose_and_drop_junk(docs_of):
    random.seed(1)
    prose = " ".join("".join(random.choice("abcdefg") for _ in range(random.randint(2, 8))) for _ in range(200))
    junk = ["the " * 200, "\n".join(["A LINE!! OF!! SHOUTING!!"] * 30), " ".join(w + "***" for w in prose.split())]
    kept = {r.doc_id for r in quality_rules.keep_good(docs_of([prose, *junk])).collect()}
    assert kept == {0}


def brute_windows(docs, items, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = {}
    for item, t in items:
        w = words(t)
        for k in range(max(len(w) - n, 0) + 1):
            if w:
                wins.setdefault(tuple(w[k : k + n]), set()).add(item)
    out = []
    for t in docs:
        w, hit, who = words(t), set(), set()
        for size in {len(x) for x in wins}:
            for k in range(len(w) - size + 1):
                if (key := tuple(w[k : k + size])) in wins:
                    hit |= set(range(k, k + size))
                    who |= wins[key]
        ids = ",".join(sorted(str(x) for x in who if x is not None))
        out.append((len(w), len(hit), len([x for x in who if x is not None]), hashlib.sha256(ids.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("block, group", [(1 << 20, 4), (40, 4), (40, 1)])
def test_decontamination(spark, docs_of, odd, block, group, monkeypatch):
    monkeypatch.setattr(decontamination, "GROUP", group)
    items = [(1, "Alpha beta gamma, delta epsilon zeta eta theta iota kappa lambda mu"), (2, "short item"), (3, None), (4, "..."), (5, "alpha BETA gamma delta epsilon zeta eta theta iota kappa"), (None, "same text of")]
    texts = [*odd, "x alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu. y", "a short-item b short item", "nothing at all in here to find"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontamination.report(docs_of(texts), bench, block_bytes=block).collect()}
    assert [got[i] for i in range(len(texts))] == brute_windows(texts, items)
    kept = {r.doc_id: r.text for r in decontamination.remove(docs_of(texts), bench, block_bytes=block).collect()}
    n = len(odd)
    assert n not in kept and kept[n + 2] == texts[n + 2]  # mostly benchmark goes, clean stays
    assert decontamination.remove(docs_of(texts), bench, whole_documents=True).count() == len(texts) - 4
    assert decontamination.report(docs_of(texts), bench.where("false")).where("contaminated").count() == 0
    assert decontamination.report(docs_of([]), bench).count() == 0


def test_spans_are_removed(spark, docs_of):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    text = "Start, a b c d e f g h i j k l m n. One two, three four five six seven eight nine TEN! end"
    assert decontamination.remove(docs_of([text]), bench).first().text == "Start, a b c d e f g h i j k l m n. ! end"


@pytest.mark.parametrize("group", [4, 1])
def test_what_stood_around_a_passage_is_scanned_again(spark, docs_of, group, monkeypatch):
    monkeypatch.setattr(decontamination, "GROUP", group)
    how = {} if group == 4 else {"block_bytes": 1}
    bench = spark.createDataFrame([("x-1", "one two three four five six seven eight nine ten"), ("x-2", "a b c")], "item_id string, text string")
    filler = " ".join(f"w{i}" for i in range(60))
    text = f"{filler} one two three four five a b c six seven eight nine ten {filler}"
    nested = "a " * 12 + filler + " b c" * 2
    kept = {r.doc_id: r.text for r in decontamination.remove(docs_of([text, filler, nested]), bench, **how).collect()}
    assert "ten" not in kept[0] and kept[0].startswith(filler) and kept[0].endswith(filler) and kept[1] == filler and kept[2] == nested
    report = {r.doc_id: (r.n_hit, r.n_items) for r in decontamination.report(docs_of([text, "a b c", filler]), bench, **how).collect()}
    assert report == {0: (3, 1), 1: (3, 1), 2: (0, 0)}


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    from fotolith.llm import textkernel

    real = textkernel.windows
    monkeypatch.setattr(textkernel, "windows", lambda tokens, rows, k: (lambda at, keys: (at, keys % 3))(*real(tokens, rows, k)))
    words = [f"w{i}" for i in range(40)]
    items = [(str(i), " ".join(words[i : i + 12])) for i in range(8)] + [("same", " ".join(words[2:14])), (None, " ".join(words[5:16]))]
    import pyarrow as pa

    block = decontamination.Windows(items, 10)
    hits, found, n = decontamination.scan(pa.array([" ".join(words[4:15]), " ".join(words[20:40])], pa.large_string()), block)
    assert found == [["2", "3", "4", "5", "same"], []] and n.tolist() == [11, 20] and hits[1] is None


def brute_components(ids, texts):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [shingles(t) for t in texts]
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if sets[i] and sets[j] and ids[i] is not None and ids[j] is not None:
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    parent[root(i)] = root(j)
    least = {}
    for i in range(len(ids)):
        if ids[i] is not None:
            least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return {(ids[i], len(sets[i]), None if ids[i] is None else least[root(i)]) for i in range(len(ids))}


def near_copies(seed, families=12, size=14, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    shared = [word() for _ in range(25)]
    texts = []
    for _ in range(families):
        base = [word() for _ in range(rng.randint(8, n))] + shared
        for _ in range(rng.randint(1, size)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[word()], [], [w[k], word()]])
            texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components(spark, docs_of, odd, seed):
    texts = odd + near_copies(seed)
    ids = [None if i == 3 else i * 7 % 1000 for i in range(len(texts))]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(docs_of(texts, ids)).collect()}
    assert got == brute_components(ids, texts)


def test_keep_one(docs_of):
    texts = ["a b c d e f g h", "A b c d e f g h", "q w e r t y u", None, None, "a b c d e f g h"]
    docs = docs_of(texts)
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4]


def test_one_id_with_two_texts(docs_of):
    words = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    texts = [words("a", 40), words("b", 40), words("a", 40) + " x", words("b", 40) + " y", words("c", 40), words("a", 40)]
    ids = [7, 7, 8, 3, 9, 7]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(docs_of(texts, ids)).collect()}
    assert got == {(7, 36, 3), (8, 37, 3), (3, 37, 3), (9, 36, 9)}
    kept = [(r.doc_id, r.text) for r in jaccard_join.keep_one(docs_of(texts, ids)).collect()]
    assert sorted(kept) == sorted([(7, texts[0]), (3, texts[3]), (9, texts[4])])


def test_a_template_with_different_rests(docs_of):
    """One prefix group whose members share the rarest shingles and little else, beside real near copies."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    common = [[word() for _ in range(60)] for _ in range(6)]
    head = [word() for _ in range(30)]
    texts = []
    for i in range(36):
        rest = common[i % 6] if i % 2 else rng.choice(common)
        tail = list(rest)
        if i % 3 == 0:
            tail[rng.randrange(60)] = word()
        texts.append(" ".join([*head, *tail]))
    texts += [" ".join(head + c) for c in common for _ in range(3)]
    ids = list(range(len(texts)))
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(docs_of(texts, ids)).collect()}
    assert got == brute_components(ids, texts)


def test_words_that_a_power_of_two_would_confuse(docs_of):
    """Thue-Morse words and lines are different words and lines."""
    a, b = thue_morse(1024), thue_morse(1024).translate({97: "b", 98: "a"})
    rest = " ".join(f"w{i}" for i in range(3))
    got = {r.doc_id: r.component_id for r in jaccard_join.join(docs_of([f"{a} {rest} z", f"{b} {rest} z"])).collect()}
    assert got == {0: 0, 1: 1}
    lines = {r.doc_id: r.n_dup_lines for r in quality_rules.annotate(docs_of([f"{a}\n{b}\n{a}", f"{a}\n{b}"])).collect()}
    assert lines == {0: 1, 1: 0}


def test_exact_sets_are_sets_of_words():
    import pyarrow as pa

    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a", "b", "Ab", "c"]) for _ in range(rng.randint(0, 9))) for _ in range(60)]
    row, s = jaccard_join.exact_sets(pa.array(texts), 3)
    names = {}
    for i, t in enumerate(texts):
        w = t.lower().split()
        want = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
        got = s[row == i].tolist()
        assert len(got) == len(want)
        names[frozenset(want)] = names.get(frozenset(want), frozenset(got))
        assert names[frozenset(want)] == frozenset(got)
    assert len(set(names.values())) == len(names)


def test_jaccard_of_nothing(docs_of):
    assert jaccard_join.join(docs_of([])).count() == 0


def brute_repeats(texts, n):
    raws = [(t or "").encode() for t in texts]
    found = Counter(r[k : k + n] for r in raws for k in range(len(r) - n + 1))
    out = []
    for r in raws:
        gone = [False] * len(r)
        for k in range(len(r) - n + 1):
            if found[r[k : k + n]] > 1:
                gone[k : k + n] = [True] * n
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), sum(gone), sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("most", [1000, 3])
def test_repeats(docs_of, odd, most):
    rng = random.Random(most)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passages = [word(rng.randint(150, 500)) for _ in range(5)]
    texts = [*odd, "x" * 700 + word(300)]
    for _ in range(40):
        p = rng.choice(passages)
        texts.append(word(rng.randint(0, 200)) + p[rng.randint(0, 40) :] + word(rng.randint(0, 200)) + rng.choice(passages)[: rng.randint(100, 500)])
    texts += [texts[-1], "y" * 200, "z" * 199, passages[0][:200] * 2, thue_morse(600), thue_morse(600).translate({97: "b", 98: "a"})]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.report(docs_of(texts), most=most).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, 200)
    assert repeats.report(docs_of([])).count() == 0


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("most", [1000, 2])
def test_repeat_groups_have_all_occurrences(docs_of, most):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage = word(260)
    texts = [word(rng.randint(0, 90)) + passage + word(rng.randint(0, 90)) for _ in range(7)] + [word(400), None]
    raws = {hashlib.sha256((t or "").encode()).hexdigest()[:32]: t for t in texts}
    found = {}
    for r in repeats.repeat_groups(docs_of(texts), most=most).collect():
        text = raws["".join(f"{x & (1 << 64) - 1:016x}" for x in (r.h1, r.h2))]
        found.setdefault((r.group, r.length), set()).add((text, r.start))
    assert found
    for (_, n), places in found.items():
        words = {t[k : k + n] for t, k in places}
        assert len(words) == 1 and n >= 200
        w = words.pop()
        assert places == {(t, k) for t in texts if t for k in range(len(t) - n + 1) if t[k : k + n] == w}
    covered = {t: set() for t in texts}
    for (_, n), places in found.items():
        for t, k in places:
            covered[t] |= set(range(k, k + n))
    assert all(len(covered[t]) >= 260 for t in texts[:7]) and not covered[texts[7]]


def test_maximal_repeats():
    import numpy as np

    rows = [b"xxabcdefgyy", b"abcdefgh", b"qqabcdefgh"]
    data = np.frombuffer(b"".join(rows), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    got = {(size, tuple(sorted(at.tolist()))) for size, at in repeats.maximal_repeats(data, offs, 6)}
    assert got == {(7, (2, 11, 21)), (8, (11, 21))}


_BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(text):
    out = []
    for k, (kind, p) in enumerate(_BASE.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_pii(docs_of, odd):
    rng = random.Random(4)
    texts = [*odd, "a@b.c-x_y@d.e", "4111 1111 1111 1111 5500-0000-0000-0004", "😀 a@b.cd 1.2.3.4 999.1.2.3.4 +1 (942) 555-3625 0", "a@b" + ".c" * 5000, "1" * 5000, "1.1." * 900, "+" + "1 " * 12]
    texts += ["".join(rng.choice("a1.@+-_% ()b9402:/x") for _ in range(60)) for _ in range(150)] + ["".join(rng.choice("0123456789- .+()") for _ in range(50)) for _ in range(150)]
    docs = docs_of(texts)
    model = pii.fit(docs)
    got = {r.doc_id: r for r in pii.report(docs, model=model).collect()}
    for i, t in enumerate(texts):
        want = brute_pii(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert [got[i][f"n_{kind}"] for kind in _BASE] == [sum(x.startswith(f"{kind}:") for x in want) for kind in _BASE], t
        assert set(want) <= set(got[i].spans.split(","))
    red = {r.doc_id: r.text for r in pii.redact(docs, model=model).collect()}
    assert red[0] is None and red[1] == ""
    assert red[len(odd) + 2].startswith("😀 <EMAIL> <IP> 999.1.2.3.4 <PHONE>")
    assert pii.report(docs_of([])).count() == 0


def test_boosting_prefers_the_telling_bit():
    import numpy as np

    codes = np.arange(8)
    yes = np.where(codes & 4, 90, 2).astype(float)
    score = pii.boost(codes, yes, 100 - yes, 3)
    assert score[codes & 4 > 0].min() > 0.8 > 0.2 > score[codes & 4 == 0].max()
