"""Operators against brute force on small tables, and the cases that every operator must handle."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowlake.llm import line_dedup
from sparrowlake.llm.components import connected_components
from sparrowlake.llm.decontaminate import decontaminate
from sparrowlake.llm.exact_dedup import exact_dedup, sha256_digest
from sparrowlake.llm.fm_index import FMIndex
from sparrowlake.llm.line_dedup import dedup_lines
from sparrowlake.llm.mixing import mix
from sparrowlake.llm.near_dedup import near_dedup
from sparrowlake.llm.quality import fit_rules, score_quality, train_quality
from sparrowlake.llm.substring_dedup import index_firsts, substring_dedup
from sparrowlake.llm.token_counts import Automaton, token_counts
from sparrowlake.llm.toxicity import score_toxicity, train_toxicity
from sparrowlake.llm.url_filter import filter_urls

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, score double, n_words string, id string, v string"


def corpus(seed=3, n=60, vocabulary=30):
    """Texts of few words, with copies, near copies, shared passages and texts that repeat themselves."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(vocabulary)}"
    line = lambda k: " ".join(word() for _ in range(k))
    shared = [line(28) for _ in range(3)]
    texts = []
    for i in range(n):
        kind = r.randrange(7)
        if kind == 0 and texts:
            texts.append(r.choice(texts))
        elif kind == 1 and texts:
            ws = r.choice(texts).split(" ")
            ws[r.randrange(len(ws))] = "changed"
            texts.append(" ".join(ws))
        elif kind == 2:
            texts.append("\n".join([line(6), r.choice(shared), line(9)]))
        elif kind == 3:
            texts.append(" ".join(line(r.randrange(1, 7)).split() * r.randrange(3, 30)))
        else:
            texts.append("\n".join(line(r.randrange(1, 12)) for _ in range(r.randrange(1, 12))))
    return texts


ODD = [None, "", " ", "\n\n\n", "ünï cödé  tab\tend", "one", "one", "UPPER one", "é" * 50, "a\x00b", "  lead", " x"]


def table(spark, texts, ids=None):
    rows = [(i, t, "en", "s", None, "k", 0.5, "n", "i", "v") for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    return [*corpus(), *ODD, "long " * 40_000 + "end"]


# -- 1


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    return sorted((i, max(groups[t or ""]), len(groups[t or ""])) for i, t in rows)


def one_byte_digest(text):
    """So short that different texts collide: bytes must decide."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 2))


@pytest.mark.parametrize("digest,files", [(sha256_digest, None), (one_byte_digest, 1)])
def test_exact(spark, tmp_path, texts, digest, files):
    path = str(tmp_path / "docs.parquet")
    table(spark, texts).repartition(3).write.parquet(path)
    out = exact_dedup(spark, path, digest=digest, files_per_batch=files).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in out) == brute_exact(list(enumerate(texts)))
    assert all(r.kept == (r.doc_id == r.keep_id) for r in out)
    if digest is sha256_digest:
        assert all(r.text_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest() for r in out)


def test_exact_ties_and_empty(spark, tmp_path):
    path = str(tmp_path / "docs.parquet")
    table(spark, ["a", "a", "a", None, ""], [5, 5, None, 1, 2]).coalesce(1).write.parquet(path)
    out = exact_dedup(spark, path).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in out) == [("1", "2", 2), ("2", "2", 2), ("5", "5", 3), ("5", "5", 3), ("None", "5", 3)]
    assert sum(r.kept for r in out) == 2
    empty = str(tmp_path / "none.parquet")
    table(spark, []).write.parquet(empty)
    assert exact_dedup(spark, empty).count() == 0


# -- 2


def brute_lines(rows):
    h = lambda line: int(hashlib.md5(line.encode()).hexdigest()[:8], 16)
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda x: x[0]):
        if t is None:
            out[i] = None
            continue
        lines = t.split("\n")
        hs = [h(x) for x in lines]
        cuts = set()
        for window, divisor, rest in ((1, 2, 0), (1, 2, 1), (2, 2, 0), (2, 2, 1), (1, 3, 0)):
            begin = 0
            for j in range(len(lines)):
                if (hs[j] + (257 * hs[j - 1] if window == 2 and j else 0)) % divisor == rest or j == len(lines) - 1:
                    cuts.add((begin, j + 1))
                    begin = j + 1
        gone = set()
        for a, b in sorted(cuts):
            body = "\n".join(lines[a:b])
            if b - a >= 2 and body.replace("\n", " ").replace("\t", " ").replace("\r", " ").strip(" "):
                if body in seen:
                    gone |= set(range(a, b))
                seen.add(body)
        out[i] = "\n".join(x for j, x in enumerate(lines) if j not in gone)
    return out


def test_lines(spark, texts):
    many = texts + ["\n".join(t.split("\n") + ["tail", "more"]) for t in texts if t]
    for digest in (line_dedup.sha256_digest, one_byte_digest):
        got = {r.doc_id: r.text for r in dedup_lines(table(spark, many), digest=digest).collect()}
        assert got == brute_lines(list(enumerate(many)))
    out = dedup_lines(table(spark, many).withColumn("n_lines", F.lit("x")), details=True)
    assert out.columns.count("n_lines") == 1 and out.agg(F.max("n_lines")).first()[0] > 5
    assert set(SCHEMA.replace(",", "").split()[::2]) <= set(out.columns)
    assert dedup_lines(table(spark, [])).count() == 0
    twins = dedup_lines(table(spark, ["a b\nc d\ne f\ng"] * 2, [None, None]))
    assert [r.text for r in twins.collect()] == ["a b\nc d\ne f\ng"] * 2


# -- 3


def brute_substrings(rows, size):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda x: x[0]):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - size + 1):
            window = tuple(w[s : s + size])
            if window in seen:
                gone[s : s + size] = [True] * size
            seen.add(window)
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    return out


@pytest.mark.parametrize("size,hot,words", [(20, 4096, 150_000), (20, 1, 200), (5, 3, 400), (1, 50, 150_000)])
def test_substrings(spark, texts, size, hot, words):
    long = " ".join(f"L{i % 700}" for i in range(2500))
    some = [*(t for t in texts if size > 5 or t is None or len(t) < 9000), "x y " * 300, long, "lead " + long]
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring_dedup(table(spark, some), size=size, hot=hot, index_words=words).collect()}
    assert got == brute_substrings(list(enumerate(some)), size)


def test_substrings_odd(spark):
    assert substring_dedup(table(spark, [])).count() == 0
    long = " ".join(f"q{i}" for i in range(30))
    out = substring_dedup(table(spark, [long, long, long], [1, 1, None])).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in out) == [("1", 0), ("1", 0), ("None", 30)]
    assert [(s["from"], s["to"]) for r in out for s in r.spans] == [(0, 30)]


def test_matching_statistics():
    rng = np.random.default_rng(1)
    texts = [rng.integers(1, 5, n) for n in (40, 7, 25)]
    whole = np.concatenate([np.append(t, 0) for t in texts])
    index = FMIndex(whole, 6, np.arange(len(whole))[::-1])
    queries = [rng.integers(1, 7, 50), texts[0][5:20], rng.integers(1, 5, 3)]
    lengths, rows = (np.split(x, np.cumsum([len(q) for q in queries])[:-1]) for x in index.matching_statistics(np.concatenate(queries), np.array([len(q) for q in queries]), 6))
    flat = [tuple(t[i : i + k]) for t in texts for k in range(1, 7) for i in range(len(t) - k + 1)]
    for q, got, at in zip(queries, lengths, rows, strict=True):
        for i in range(len(q)):
            best = max([k for k in range(1, 7) if i + k <= len(q) and tuple(q[i : i + k]) in flat], default=0)
            assert got[i] == best
            if best == 6:  # the least rank is the last place, as ranks go down
                last = max(p for p in range(len(whole)) if tuple(whole[p : p + 6]) == tuple(q[i : i + 6]))
                assert index.least_rank(at[i : i + 1])[0] == len(whole) - 1 - last


def test_firsts_follow_the_matching_statistics(monkeypatch):
    """What the index reports decides: with statistics that are one short, windows that repeat count as firsts."""
    r = random.Random(1)
    segs = [" ".join(f"s{r.randrange(3)}" for _ in range(12)).encode() for _ in range(30)]
    places = [(i, b"", 0) for i in range(30)]
    seen, want = set(), []
    for s in segs:
        w = s.split()
        want.append([tuple(w[i : i + 4]) not in seen for i in range(len(w) - 3)])
        want[-1] = [x and w[i : i + 4] not in (w[j : j + 4] for j in range(i)) for i, x in enumerate(want[-1])]
        seen |= {tuple(w[i : i + 4]) for i in range(len(w) - 3)}
    one = np.zeros(30, dtype=np.int64)
    assert [m.tolist() for m in index_firsts(segs, places, one, 4)] == want
    exact = FMIndex.matching_statistics
    monkeypatch.setattr(FMIndex, "matching_statistics", lambda self, *q: (exact(self, *q)[0] - 1, exact(self, *q)[1]))
    assert sum(m.sum() for m in index_firsts(segs, places, one, 4)) > sum(map(sum, want))


def test_search_stops_where_no_window_can_match(monkeypatch):
    """Segments that differ in a late word are left after it: they were followed down to their first word."""
    steps = []
    extend = FMIndex.extend
    monkeypatch.setattr(FMIndex, "extend", lambda self, symbol, lo, hi: steps.append(len(symbol)) or extend(self, symbol, lo, hi))
    same = [f"s{i}" for i in range(22)]
    segs = [" ".join([*same, f"end{i}", "tail"]).encode() for i in range(100)]
    masks = index_firsts(segs, [(i, b"", 0) for i in range(100)], np.zeros(100, dtype=np.int64), 24)
    assert all(m.tolist() == [True] for m in masks)
    assert sum(steps) < 100 * 3 * 8  # up to three words in each of at most eight rounds

    rng = np.random.default_rng(2)
    whole = np.append(rng.integers(1, 4, 400), 0)
    index = FMIndex(whole, 6, np.arange(len(whole)))
    sizes = rng.integers(6, 20, 200)
    flat = rng.integers(1, 5, int(sizes.sum()))
    every, some = index.matching_statistics(flat, sizes, 6)[0], index.matching_statistics(flat, sizes, 6, 6)[0]
    assert 0 < (every == 6).sum() < len(flat) and ((every == 6) == (some == 6)).all() and (some <= every).all()


def test_wavelet_levels_of_many_symbols():
    rng = np.random.default_rng(3)
    text = np.append(rng.integers(1, 5000, 3000), 0)
    index = FMIndex(text, 3, np.arange(len(text)))
    assert len(index.levels) == 4
    for at in range(0, 2990, 130):
        lengths, rows = index.matching_statistics(text[at : at + 3], np.array([3]), 3)
        assert lengths.tolist() == [3, 2, 1] and index.least_rank(rows[:1])[0] == at


def test_substrings_of_neighbouring_copies(spark):
    """Texts that go whole, one after another, and words parted by all kinds of blanks."""
    words = [f"é{i}" for i in range(30)]
    texts = [" ".join(words), "\n\t".join(words), "\r\x0b\x0c".join(words) + " ", "", " own  " + " ".join(words) + "\tends here", " ".join(words)]
    out = {r.doc_id: r for r in substring_dedup(table(spark, texts).coalesce(1)).collect()}
    assert [(out[i].n_words, out[i].n_removed, out[i].text) for i in range(6)] == [(30, 0, " ".join(words)), (30, 30, ""), (30, 30, ""), (0, 0, ""), (33, 30, "own ends here"), (30, 30, "")]
    assert [[(s["from"], s["to"]) for s in out[i].spans] for i in range(6)] == [[], [(0, 30)], [(0, 30)], [], [(1, 31)], [(0, 30)]]


# -- 4


def brute_leaks(rows, items, size=10):
    import re

    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    wins = {}
    for k, t in items:
        w = words(t)
        for s in range(max(1, len(w) - size + 1) if w else 0):
            wins.setdefault(tuple(w[s : s + size]), set()).add(str(k))
    out = {}
    for i, t in rows:
        w = words(t)
        hit, found = set(), set()
        for n in {len(x) for x in wins}:
            for s in range(len(w) - n + 1):
                if (x := tuple(w[s : s + n])) in wins:
                    hit |= set(range(s, s + n))
                    found |= wins[x]
        out[i] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("most", [200_000, 0])
def test_leaks(spark, texts, most):
    parts = [t.split() for t in texts if t and len(t.split()) > 30 and len(t) < 9000]
    items = [(1, " ".join(parts[0][3:20])), (2, " ".join(parts[1][:12]).upper()), (3, "one"), (4, ""), (5, None), (10, " ".join(parts[0][3:20])), (7, "never anywhere seen"), (8, "w1 w2 !!! w1")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate(table(spark, texts), bench, broadcast_rows=most).collect()}
    assert got == brute_leaks(list(enumerate(texts)), items)
    assert decontaminate(table(spark, []), bench).count() == 0
    assert {r.n_hit for r in decontaminate(table(spark, texts[:5]), bench.where("item_id < 0")).collect()} == {0}


# -- 5


def test_tokens(spark, texts):
    from tokenizers import models

    vocabulary = (["w", "w1", "one", "a", "ab", "abc", "u", "chan"], ["0", "1", "2", "ged", "g", "e", "d", "bcd", "b", "c", "n", "12", "123", "cdx"])
    ids = {"[UNK]": 0}
    for p in (*vocabulary[0], *("##" + x for x in vocabulary[1])):
        ids.setdefault(p, len(ids))
    model = models.WordPiece(ids, unk_token="[UNK]", max_input_chars_per_word=10**6)
    automaton = Automaton(*vocabulary)
    r = random.Random(2)
    words = ["".join(r.choice("abcdwu123ge") for _ in range(r.randrange(1, 9))) for _ in range(4000)] + ["w123", "changed", "abcdx", "one", "é"]
    for w in words:
        found = model.tokenize(w)
        assert automaton.count(w) == (-1 if [t.value for t in found] == ["[UNK]"] else len(found)), w
    got = {r.doc_id: (r.n_words, r.n_tokens, r.n_unknown) for r in token_counts(table(spark, texts), vocabulary=vocabulary).collect()}
    for i, t in enumerate(texts):
        ws = (t or "").encode().split()
        each = [model.tokenize(w.decode()) for w in set(ws)]
        n = dict(zip(set(ws), each, strict=True))
        assert got[i] == (len(ws), sum(len(n[w]) for w in ws), sum([x.value for x in n[w]] == ["[UNK]"] for w in ws))


# -- 6, 7


def labelled(spark, n, texts_of):
    rows = [(i, *texts_of(i)) for i in range(n)]
    docs = spark.createDataFrame([(i, t, "de" if i % 3 else None) for i, t, _ in rows] + [(n, None, "en"), (n + 1, "", "en"), (n + 2, "z" * 30_000, None)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, y int")
    return docs, labels, {i: y for i, _, y in rows}


def test_quality(spark):
    r = random.Random(4)

    def make(i):
        words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) for _ in range(r.randrange(20, 80))]
        bad = i % 4 == 0
        return (" ".join(w.upper() + "!!" for w in words) if bad else ". ".join(words)), int(not bad)

    docs, labels, y = labelled(spark, 240, make)
    model = train_quality(docs, labels, "y")
    out = score_quality(docs.withColumn("score", F.lit(3)), model).collect()
    assert len(out) == 243 and all(0 <= x.score <= 1 for x in out) and 0 < len(model.rules) < 200
    held = [x for x in out if x.doc_id in y and zlib.crc32(str(x.doc_id).encode()) % 3 == 1]
    assert len(held) > 40 and np.mean([(x.score >= 0.5) == y[x.doc_id] for x in held]) > 0.97
    flipped = labels.withColumn("y", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("y")).otherwise(F.col("y")))
    assert train_quality(docs, flipped, "y") == model  # held-out labels are not read
    nothing = train_quality(docs, labels.where("doc_id < 0"), "y")
    assert {x.score for x in score_quality(docs, nothing).collect()} == {0.5}
    assert fit_rules(np.zeros((3, 11)), np.ones(3)).bias > 0
    assert score_quality(docs.limit(0), model).count() == 0


def test_toxicity(spark):
    r = random.Random(5)

    def make(i):
        words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) for _ in range(r.randrange(20, 120))]
        bad = i % 5 == 0
        if bad:
            words[r.randrange(len(words))] = r.choice(["Rotten", "foulword", "zzzz" + words[0]])
        return " ".join(words), int(bad)

    docs, labels, y = labelled(spark, 500, make)
    model = train_toxicity(docs, labels, "y")
    out = score_toxicity(docs, model).collect()
    assert len(out) == 503 and all(0 <= x.score <= 1 for x in out)
    held = [x for x in out if x.doc_id in y and zlib.crc32(str(x.doc_id).encode()) % 3 == 1]
    assert np.mean([(x.score >= 0.7) == y[x.doc_id] for x in held]) > 0.95
    none = train_toxicity(docs, labels.where("y = 0 and doc_id < 0"), "y")
    assert {round(x.score, 6) for x in score_toxicity(docs, none).collect()} == {0.5}
    assert score_toxicity(docs.limit(0), model).count() == 0


def test_models_on_repeated_rows(spark):
    """Rows that repeat an id or clash in names, and texts over the 4,096 words that are scored at once."""
    r = random.Random(6)
    words = [f"k{i}" for i in range(50)]
    texts = [" ".join(["Awful!!" if i % 3 == 0 else "fine", *r.sample(words, 12)]) for i in range(90)]
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, y int").withColumn("text", F.lit("clash"))
    many = docs.union(docs).union(docs.where("doc_id < 20"))
    assert train_quality(many, labels, "y") == train_quality(docs, labels, "y")
    a, b = train_toxicity(docs, labels, "y"), train_toxicity(many, labels, "y")
    long = " ".join(["calm"] * 4090 + ["fine", "Awful!!", "end"] * 5 + ["calm"] * 5000)
    some = table(spark, [*texts[:5], long, None, "", long])
    scores = [sorted((x.doc_id, x.score) for x in score_toxicity(some, m).collect()) for m in (a, b)]
    assert scores[0] == scores[1] and scores[0][5][1] == scores[0][8][1] and scores[0][6][1] == scores[0][7][1]
    assert score_quality(many, train_quality(docs, labels, "y")).columns.count("score") == 1


# -- 8


def test_toxicity_sample_has_no_cliff(spark):
    from sparrowlake.llm import toxicity

    texts = [("you stupid idiot fool" if i % 2 else "a calm and pleasant day") + f" w{i}" for i in range(60)]
    first = min(range(60), key=lambda i: spark.range(60).selectExpr("id", "xxhash64(id) h").collect()[i].h)
    texts[first] += " long" * 2000
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.train_toxicity(table(spark, texts), labels, sample_bytes=8000)
    scores = {r.score for r in toxicity.score_toxicity(table(spark, texts), model).collect()}
    assert len(scores) > 2
    assert toxicity._fitting([30, 5, 9, 3], 10) == [False, True, False, True]


def test_mixing(spark):
    import math

    docs = table(spark, [f"t{i}" for i in range(600)]).withColumn("source", F.expr("CASE WHEN doc_id % 3 = 0 THEN 'a' WHEN doc_id % 10 = 1 THEN NULL ELSE 'b' END"))
    out = mix(docs, weights={"a": 3.0, "b": 1.0}, size=2.0)
    got = {}
    for x in out.collect():
        got.setdefault(x.doc_id, []).append(x.copy_no)
    n_a = 200
    n_b = docs.where("source = 'b'").count()
    for x in docs.collect():
        rate = {"a": 0.75 * 1200 / n_a, "b": 0.25 * 1200 / n_b}.get(x.source, 0.0)
        u = int(hashlib.md5(f"7|{x.doc_id}|1".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-rate)
        cdf = p
        while rate and u >= cdf:
            k += 1
            p *= rate / k
            cdf += p
        assert sorted(got.get(x.doc_id, [])) == list(range(1, k + 1))
    big = mix(docs.limit(40).withColumn("source", F.lit("x")), weights={"x": 1.0}, size=500.0).groupBy("doc_id").count().collect()
    assert len(big) == 40 and 480 < np.mean([x["count"] for x in big]) < 520  # rates over STEP are summed draws
    assert mix(docs.limit(0)).count() == 0
    twice = mix(docs.union(docs), size=1.0).groupBy("doc_id", "copy_no").count().collect()
    assert {x["count"] for x in twice} == {2}
    assert mix(docs, weights={"nowhere": 1.0}).count() == 0


# -- 9


def test_urls(spark):
    pages = [
        (1, "http://a.example.net/x", ""), (2, "http://EXAMPLE.net/en/y?z", ""), (3, "https://sub.example.com/de/", ""), (4, "https://example.com/en/", ""), (5, "ftp://x.org/fr/a#b", None), (6, None, "x"), (7, "no address", ""),
        (8, "http://q.org/one", '<LINK href="http://q.org/two" rel=canonical>'), (9, "http://q.org/two", '<meta http-equiv="Refresh" content="0; url=http://bad.net/z">'), (10, "http://q.org/alone", '<link rel="stylesheet" href="http://bad.net/s">'),
        (11, "http://notnet/x", ""), (12, "http://x.org/fr/in", '<link rel="canonical" href="http://bad.net/z">'), (13, "://net/", ""), (14, "http://net?x", ""), (4, "https://example.com/en/", ""),
    ]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("host", F.lit("clash"))
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in filter_urls(df).collect())
    assert [(g[0], g[3], g[4]) for g in got] == [
        (1, "net/", "block"), (2, "example.net/en/", "allow"), (3, "example.com/de/", "block"), (4, None, "allow"), (4, None, "allow"), (5, "org/fr/", "allow"), (6, None, "allow"), (7, None, "allow"), (8, None, "block"), (9, None, "block"),
        (10, None, "allow"), (11, None, "allow"), (12, "org/fr/", "allow"), (13, "net/", "block"), (14, None, "allow"),
    ]
    assert got[1][1:3] == ("example.net", "/en/y") and got[6][1:3] == ("", "") and got[14][1:3] == ("net", "")
    more = spark.createDataFrame([("https://example.com/en/", "http://m.net/")], "url string, target string")
    assert {r.verdict for r in filter_urls(df, redirects=more).where("page_id = 4").collect()} == {"block"}
    assert filter_urls(df.limit(0)).count() == 0


def test_url_aliases(spark):
    """Relative links, other spellings of one address, several links of a page; and the registered SQL on the same pages."""
    import duckdb

    from sparrowlake.llm import oracles

    pages = [
        ("HTTP://Q.org/a/b#top", '<link rel="alternate canonical" href="/a/c">'), ("http://q.org/a/c", '<link rel=canonical href="#x"><link rel=canonical href="d?x=1&amp;y=2">'),
        ("http://q.org/a/d?x=1&y=2", '<meta content="3;URL=//BAD.net/z#f" http-equiv=refresh>'), ("http://r.org", '<link rel="canonical" href="e">'), ("http://r.org/e", '<link href="?p" rel="canonical">'),
        ("http://r.org/e?p", '<link href="mailto:x@bad.net" rel="canonical">'), ("http://s.org/x", None), ("http://s.org/y", '<link rel="canonical" href="HTTP://S.org/x">'), ("https://example.com/de/k", '<link rel="canonical" href="http://s.org/x#1">'),
        ("no address", '<link rel="canonical" href="http://bad.net/">'), (None, '<link rel="canonical" href="http://bad.net/">'), ("http://t.org/1", '<link rel="canonicalize" href="http://bad.net/">'),
    ]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id bigint, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(df).collect()}
    assert sorted(i for i, r in got.items() if r[3] == "block") == [0, 1, 2, 6, 7, 8]
    con = duckdb.connect()
    con.register("pages", df.toPandas())
    assert {r[0]: r[1:] for r in con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({oracles.OP9_URL_FILTER})").fetchall()} == got


def test_components(spark):
    r = random.Random(6)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(1, 90)]
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {n: find(n) for a, b in edges if a != b for n in (a, b)}


# -- 10


def brute_near(rows, percent=85, size=5):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = []
    for i, t in rows:
        w = (t or "").encode().translate(low).split()
        sets.append((i, frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()))
    up = {i: i for i, _ in sets}
    find = lambda x: x if up[x] == x else find(up[x])
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets}


@pytest.mark.parametrize("limit", [2000, 4])
def test_near(spark, texts, limit):
    r = random.Random(8)
    base = [f"b{r.randrange(500)}" for _ in range(90)]
    near = []
    for k in range(40):  # a chain of edits: neighbours are alike, ends are not
        base[r.randrange(90)] = f"n{k}"
        near.append(" ".join(base))
    some = [*texts, " ".join(["lead", *near[-1].split() * 200]), *near, " ".join(near[-1].split() * 200)]
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in near_dedup(table(spark, some), node_limit=limit).collect()}
    want = brute_near(list(enumerate(some)))
    if limit == 2000:
        assert got == want
    else:  # nodes are cut far below what they hold: every link found is true, few are lost
        assert all(got[i][0] == want[i][0] and want[got[i][1]][1] == want[i][1] for i in want)
        assert sum(got[i] == want[i] for i in want) > 0.9 * len(want)


def test_near_odd(spark):
    assert near_dedup(table(spark, [])).count() == 0
    out = near_dedup(table(spark, ["a b c d e f", "a b c d e f", "A b  c d e f", None, ""], [3, 3, 1, 5, None])).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.n_shingles) for r in out) == [("1", "1", 2), ("3", "1", 2), ("3", "1", 2), ("5", "5", 0), ("None", "None", 0)]


def test_near_large_node(spark):
    """Texts that share most words, of which only neighbours in a chain are alike: no node gets smaller, and each link is needed."""
    r = random.Random(4)
    near = [" ".join([*(f"c{i}" for i in range(280)), *(f"t{k}_{i}" for k in range(j, j + 6) for i in range(20))]) for j in range(100)]
    r.shuffle(near)
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in near_dedup(table(spark, near), node_limit=20, max_depth=0).collect()}
    want = brute_near(list(enumerate(near)))
    assert {c for _, c, _ in want.values()} == {0}
    assert got == want


@pytest.mark.parametrize("limit", [2000, 30])
def test_near_hub(spark, limit):
    """Edited copies of one text, most of them alike to that text only."""
    r = random.Random(3)
    hub = [f"h{i}" for i in range(204)]
    texts = []
    for k in range(400):
        ws = list(hub)
        for e in range(3 if k != 200 else 0):
            ws[r.randrange(204)] = f"x{k}_{e}"
        texts.append(" ".join(ws))
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in near_dedup(table(spark, texts), node_limit=limit).collect()}
    assert got == brute_near(list(enumerate(texts))) and {c for _, c, _ in got.values()} == {0}


def test_near_texts_of_one_id(spark):
    """Rows are documents: two texts of one id are searched and confirmed each on its own."""
    r = random.Random(9)
    for _ in range(3):
        a, b = ([f"{x}{r.randrange(10**6)}" for _ in range(90)] for x in "ab")
        near = lambda ws: " ".join(["changed", *ws[1:]])
        rows = [(3, " ".join(a)), (3, " ".join(b)), (1, near(a)), (2, near(b)), (4, None), (4, " ".join(a))]
        out = near_dedup(table(spark, [t for _, t in rows], [i for i, _ in rows])).collect()
        assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in out) == [(1, 86, 1), (2, 86, 2), (3, 86, 1), (3, 86, 2), (4, 0, 4), (4, 86, 1)]


def test_ids_that_are_no_numbers(spark):
    with pytest.raises(TypeError, match="whole number"):
        near_dedup(table(spark, ["a"]), id_col="key")


def test_word_hashes():
    """Long words that a polynomial hash modulo a power of two cannot tell apart, and words at all lengths about eight bytes."""
    import pyarrow as pa

    from sparrowlake.llm import textnp

    flip = [bin(i).count("1") % 2 for i in range(2048)]
    words = ["".join("ab"[x] for x in flip), "".join("ba"[x] for x in flip), *("c" * n for n in range(1, 300)), "c" * 8 + "\x00"]
    blocks = list(textnp.blocks(pa.array([" ".join(words), " ".join(reversed(words))]), textnp.separators()))
    h = np.concatenate([b.hashes() for b in blocks])
    n = len(words)
    assert len(set(h.tolist())) == n and h[:n].tolist() == h[n:][::-1].tolist()
