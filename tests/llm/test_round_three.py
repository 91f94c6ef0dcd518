"""Lexical search, language field and spelling variants: brute force, held-out accuracy, edge cases."""
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from slipway.llm import crf, maxsketch, spelling
from slipway.llm.common import table
from tests.conftest import SF001

DOCS = "doc_id long, text string, lang string, source string, n_chars long, item long, word string, key string, rank int"
FOLD = {i: i + 32 for i in range(65, 91)}


def frame(spark, rows, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", 0, 1, "w", "k", 1) for i, t in rows], DOCS)


# ---------------------------------------------------------------- op11
def brute_ranking(docs, items, top=50):
    def terms(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(FOLD))

    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, q in asked.items():
        got = []
        for d, b in bags:
            m = 100 - 50 + 50 * sum(b.values()) * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * b[t] // (1000 * b[t] + 20 * m))
                    for t in q if b[t])
            if s > 0:
                got.append((-s, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(got)[:top], 1)]
    return out


def some_texts(n, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"t{int(rng.paretovariate(0.7)) % 400}" for _ in range(2000)]
    return [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 60))) for _ in range(n)]


def test_max_sketch_against_brute_force(spark, monkeypatch):
    texts = some_texts(300)
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000, texts[0]), (1000, texts[0]), (1001, None), (1002, ""), (None, texts[5]),
                                                   (1003, "... !"), (1004, "É T1 t1"), (1005, " ".join(texts) * 3)]
    items = [(7, texts[3]), (8, "t1 T2 é"), (9, None), (10, "zzz"), (7, "t5"), (None, "t3 t4"), (11, texts[11])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute_ranking(rows, items, 20), key=str)
    docs = frame(spark, rows).repartition(3)
    monkeypatch.setattr(maxsketch, "LOAD", 2)  # many collisions: bounds far above the scores
    monkeypatch.setattr(maxsketch, "PIECE", 64)  # texts split anywhere
    got = maxsketch.search(maxsketch.build(docs), bench, 20, block=2).collect()
    assert sorted([tuple(r) for r in got], key=str) == want
    assert [f.name for f in maxsketch.search(maxsketch.build(docs), bench).schema] == ["item_id", "rank", "doc_id", "score"]


def test_max_sketch_empty(spark):
    bench = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert maxsketch.search(maxsketch.build(frame(spark, [])), bench).count() == 0
    assert maxsketch.search(maxsketch.build(frame(spark, [(1, "a")])), bench.limit(0)).count() == 0
    assert maxsketch.search(maxsketch.build(frame(spark, [(1, None), (2, " ")])), bench).count() == 0


def test_sketch_bounds_never_below_scores():
    texts = pa.array(some_texts(200))
    row, h, tf = maxsketch.term_counts(texts)
    n = np.bincount(row, tf, len(texts)).astype(np.int64)
    bits, at, step, ptr = maxsketch.sketches(row, h, tf, len(texts))
    q = maxsketch.Queries([h[row == r] for r in range(0, 200, 10)], 200, int(n.sum()))
    q.weigh(dict(zip(*[x.tolist() for x in np.unique(h.view(np.int64), return_counts=True)])))
    batch = pa.RecordBatch.from_arrays([pa.array(n), pa.array(bits.astype(np.int32)), maxsketch._binaries(at, ptr),
                                        maxsketch._binaries(step, ptr)], ["n", "bits", "coords", "steps"])
    exact = q.scores(texts, n)
    seen = 0
    for some, bound in q.bounds(batch):
        assert (bound >= exact[some]).all()
        seen += len(some)
    assert seen == 200 and exact.max() > 0


def test_pieces_cut_no_term(monkeypatch):
    texts = pa.array(["ab cd" * 50, "", None, "x" * 300, "é ü" * 40 + "y" * 100, "last"])
    whole = maxsketch.term_counts(texts)
    for size in (1, 7, 50, 256):
        monkeypatch.setattr(maxsketch, "PIECE", size)
        for a, b in zip(maxsketch.term_counts(texts), whole):
            assert np.array_equal(a, b)


# ---------------------------------------------------------------- op12
def brute_posteriors(e, start, step):
    k = e.shape[1]
    out = np.zeros(e.shape)
    for tags in itertools.product(range(k), repeat=len(e)):
        w = math.exp(start[tags[0]] + sum(step[a, b] for a, b in zip(tags, tags[1:])) + sum(e[i, y] for i, y in enumerate(tags)))
        for i, y in enumerate(tags):
            out[i, y] += w
    return out / out.sum(axis=1, keepdims=True)


def test_forward_backward_against_all_paths(monkeypatch):
    rng = np.random.default_rng(1)
    e, start, step = rng.normal(size=(15, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    ptr = np.array([0, 6, 6, 7, 15])
    for block in (2, 4, 32):
        monkeypatch.setattr(crf, "STEP", block)
        got = crf.posteriors(e, ptr, start, step)
        for a, b in zip(ptr[:-1], ptr[1:]):
            if b > a:
                assert np.allclose(got[a:b], brute_posteriors(e[a:b], start, step))


def test_transition_gradient_matches_differences():
    rng = np.random.default_rng(2)
    e, start, step = rng.normal(size=(4, 6, 3)), rng.normal(size=3), rng.normal(size=(3, 3))

    def log_total(s):
        total = 0
        for x in e:
            v = start + x[0]
            for t in range(1, len(x)):
                v = np.logaddexp.reduce(v[:, None] + s, axis=0) + x[t]
            total += np.logaddexp.reduce(v)
        return total

    _, moved = crf._pairs(e, start, step)
    for i, j in ((0, 0), (1, 2), (2, 1)):
        d = np.zeros((3, 3))
        d[i, j] = 1e-5
        assert abs((log_total(step + d) - log_total(step - d)) / 2e-5 - moved[i, j]) < 1e-5


@pytest.fixture(scope="module")
def field(spark):
    docs = table(spark, SF001, "documents")
    return docs, crf.train(docs)


def test_language_held_out(field):
    docs, model = field
    got = crf.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    n, right = got.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 20 and right / n >= 0.97


def test_code_switched_text(spark, field):
    docs, model = field
    pick = {r["lang"]: r["text"] for r in docs.filter("lang in ('en', 'es') and n_chars > 400").collect()}
    one, two = (" ".join(re.findall(r"[^\W\d_]+", pick[x])[:20]) for x in ("en", "es"))
    text = f"{one}. {two} ! {one}"
    got = [r.asDict() for r in crf.runs(frame(spark, [(1, "a-1"), (2, text)]), model).filter("doc_id = 2").orderBy("start").collect()]
    words = {x: sum(r["n_words"] for r in got if r["lang"] == x) for x in ("en", "es")}
    assert sum(r["n_words"] for r in got) == 60 and words["en"] >= 34 and words["es"] >= 15 and len(got) <= 8
    assert got[0]["start"] == 0 and got[-1]["end"] == len(text)


def test_language_edges(spark, field):
    _, model = field
    rows = [(1, None), (2, ""), (3, "12 + 3 …"), (None, "the and of"), (4, "x" * 5000), (5, "the and of"), (5, "the and of")]
    got = crf.predict(frame(spark, rows), model).collect()
    assert len(got) == 7 and all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in got if r["doc_id"] in (1, 2, 3))
    assert len({(r["lang_pred"], r["score"]) for r in got if r["doc_id"] in (None, 5)}) == 1
    assert all(0 <= r["score"] <= 1 for r in got)
    none = crf.train(frame(spark, rows, None))
    assert {r["lang_pred"] for r in crf.predict(frame(spark, rows), none).collect()} == {"und"}
    assert crf.predict(frame(spark, []), crf.train(frame(spark, []))).count() == 0
    one = crf.train(frame(spark, [(i, "only this") for i in range(20)], "xx"))
    assert {(r["lang_pred"], r["score"]) for r in crf.predict(frame(spark, [(1, "any")]), one).collect()} == {("xx", 1.0)}


def test_long_text_in_pieces(monkeypatch, field):
    _, model = field
    text = "the and of with " * 400
    monkeypatch.setattr(crf, "PIECE", 1000)
    cut = list(crf.words(pa.array(["of", text, "é" * 900, None, "the"])))
    n = sum(len(s) for *_, s, _, _ in cut)
    assert n == 1 + 1600 + 2 + 1 and max(len(c) for _, _, _, c, *_ in cut) <= 1000


# ---------------------------------------------------------------- op13
def brute_variants(rows):
    n = Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", (t or "").translate(FOLD)):
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 5:
                n[w] += 1
    n = {w: c for w, c in n.items() if c >= 3}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    by = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, vs in by.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(by[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def variant_texts(n, seed=5):
    rng = random.Random(seed)
    stems = ["".join(rng.choices("abé", k=rng.randrange(4, 9))) for _ in range(60)]
    return [" ".join(rng.choices(stems, weights=[1 / (i + 1) for i in range(60)], k=40)).title() for _ in range(n)]


@pytest.mark.parametrize("tile", [4, 512])
def test_spelling_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(spelling, "ROWS", 8)
    rows = list(enumerate(variant_texts(120))) + [(None, "Abbab abbab abbab"), (500, None), (501, ""), (502, "12"),
                                                 (503, "z" * 400 + " " + "z" * 401), (504, "z" * 400 + " " + "z" * 401),
                                                 (505, "z" * 400 + " " + "z" * 401),
                                                 (506, "chaineda " * 4), (507, "chainedb " * 9), (508, "chainecb " * 20)]
    docs = frame(spark, rows)
    got = sorted([tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n"))
                  for r in spelling.group_variants(docs, tile).collect()])
    want = brute_variants(rows)
    assert got == want and any(w[1] for w in want) and any(w[2] not in (w[0], w[1]) for w in want)


def test_spelling_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BROADCAST_ROWS", 0)
    rows = list(enumerate(variant_texts(40)))
    got = sorted((r["word"], r["n_near"]) for r in spelling.group_variants(frame(spark, rows), 4).collect())
    assert got == [(w[0], w[4]) for w in brute_variants(rows)]


def test_spelling_empty(spark):
    assert spelling.group_variants(frame(spark, [])).count() == 0
    assert spelling.group_variants(frame(spark, [(1, None), (2, "short words only")])).count() == 0


def test_compare_all_short_strings():
    """Every pair of strings over two letters is near in exactly one (length, part) or in none."""
    words = ["".join(w) for k in (5, 6) for w in itertools.product("ab", repeat=k)]
    found = Counter()
    for longer in (5, 6, 7):
        for part in range(spelling.PARTS):
            a, b = longer * part // spelling.PARTS, longer - longer * (part + 1) // spelling.PARTS
            group: dict = {}
            for w in words:
                if len(w) in (longer, longer - 1):
                    group.setdefault((w[:a], w[len(w) - b:]), []).append(w)
            for some in group.values():
                m = spelling.compare(some, np.full(len(some), longer), np.full(len(some), part), np.zeros(len(some)),
                                     np.full(len(some), -1))
                found.update((some[i], some[j]) for i, j in zip(*np.nonzero(m)))
    assert set(found.values()) == {1}
    assert {w: sum(1 for a, _ in found if a == w) for w in words[:3]} == {
        w: sum(1 for v in words if v != w and (len(v) == len(w) and sum(x != y for x, y in zip(v, w)) == 1 or abs(len(v) - len(w)) == 1 and any(
            max(v, w, key=len)[:i] + max(v, w, key=len)[i + 1:] == min(v, w, key=len) for i in range(max(len(v), len(w)))))) for w in words[:3]}


# ---------------------------------------------------------------- memory, names
def test_a_long_text_keeps_the_shingles_small():
    """One text of 20 MB, shingled in a process of its own: below 400 MB, imports included."""
    import subprocess
    import sys
    code = ("import re, numpy as np, pyarrow as pa\n"
            "from slipway.llm import ngramjoin\n"
            "w = np.random.default_rng(0).integers(97, 123, 20_000_000).astype(np.uint8); w[::7] = 32\n"
            "col = pa.array([w.tobytes().decode()]); del w\n"
            "sets, ptr = ngramjoin.shingle_sets(col)\n"
            "peak = re.search(r'VmHWM:\\s*(\\d+)', open('/proc/self/status').read())[1]\n"  # of this process image alone
            "print(len(sets), int(peak) // 1024)")
    n, mb = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert n > 2_000_000 and mb < 400


def test_shingles_do_not_depend_on_pieces(monkeypatch):
    from slipway.llm import common, ngramjoin
    texts = pa.array(["a b c d e f g " * 30, "", None, "x y", "one", "w " * 100 + "long" * 80])
    want = ngramjoin.shingle_sets(texts)
    for size in (1, 5, 64):
        monkeypatch.setattr(ngramjoin, "pieces", lambda d, o, i, s=size: common.pieces(d, o, i, s))
        for a, b in zip(ngramjoin.shingle_sets(texts), want):
            assert np.array_equal(a, b)


def test_stages_keep_columns_of_any_name(spark):
    from slipway.llm import decontaminate, ngramjoin
    docs = frame(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (3, "one two three")])
    for c in ("_key", "gone", "_gone", "KEY", "id", "comp"):
        docs = docs.withColumn(c, F.lit(c))
    bench = spark.createDataFrame([(1, "two three")], "item_id long, text string")
    kept = ngramjoin.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
    clean = decontaminate.keep_clean(docs, bench)
    assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == [1, 2]


# ---------------------------------------------------------------- op6, repeated words
def brute_hits(docs, items, window=10):
    """{doc_id: (n_hit, item ids)} by comparing every window of words."""
    def words(t):
        return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD)) if w]

    out = {}
    for i, t in docs:
        w, hit, own = words(t), set(), set()
        for name, x in items:
            v = words(x)
            n = min(len(v), window)
            wins = {tuple(v[a:a + n]) for a in range(len(v) - n + 1)} if n else set()
            for a in range(len(w) - n + 1):
                if tuple(w[a:a + n]) in wins:
                    hit |= set(range(a, a + n))
                    own.add(name)
        out[i] = (len(hit), len(own))
    return out


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_decontaminate_repeated_words(spark, monkeypatch, broadcast):
    from slipway.llm import decontaminate
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast)  # both join paths
    rng = random.Random(4)
    items = [("one", "na " * 300), ("two", "a b " * 60), ("short", "x x x"), ("mixed", "a b " * 9 + "c " + "a b " * 9),
             ("again", " ".join(f"w{k}" for k in range(15)) + " sep " + " ".join(f"w{k}" for k in range(15)))]
    docs = [(1, "na " * 500), (2, "b a " * 40 + "c"), (3, "x x x x y x x"), (4, "a b " * 4 + "c " + "a b " * 4),
            (5, " ".join(f"w{k}" for k in range(3, 15)) + " w0 w1"), (6, "na " * 9), (7, None), (8, "")]
    docs += [(10 + k, " ".join(rng.choice("ab c".split()) for _ in range(60))) for k in range(20)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"])
           for r in decontaminate.report(frame(spark, docs), bench).collect()}
    assert got == brute_hits(docs, items)


def test_decontaminate_long_repetition(spark):
    from slipway.llm import decontaminate
    docs = frame(spark, [(1, "na " * 20_000), (2, "clean words only here")])
    bench = spark.createDataFrame([("one", "na " * 20_000)], "item_id string, text string")
    assert {r["doc_id"]: r["n_hit"] for r in decontaminate.report(docs, bench).collect()} == {1: 20_000, 2: 0}


# ---------------------------------------------------------------- op10, several shards and blocks
@pytest.mark.parametrize("factor, least", [(1.0, 1.0), (None, 0.9)])
def test_neighbours_over_shards(spark, monkeypatch, factor, least):
    from slipway.llm import annsearch
    monkeypatch.setattr(annsearch, "SHARD_ROWS", 120)
    monkeypatch.setattr(annsearch, "QUERY_ROWS", 8)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 16))
    x[50:60] = x[40]  # a group of copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = annsearch.neighbours(df, F.col("vec_id") % 20 == 0, k=10, factor=factor).collect()
    found = 0
    for a in range(0, 400, 20):
        s = x @ x[a]
        best = sorted((i for i in range(400) if i != a), key=lambda i: (-round(s[i], 9), i))[:10]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == a)
        assert [r[0] for r in mine] == list(range(1, 11))
        assert all(abs(r[2] - s[r[1]]) < 1e-9 for r in mine)
        found += len({r[1] for r in mine} & set(best))
    assert found >= least * 200


def test_vantage_point_bounds_skip_vectors():
    from slipway.llm import annsearch
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2000, 3))
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree, tally = annsearch.build(np.arange(2000), x), [0]
    score, _ = annsearch.search(tree, x[:100], 5, 1.0, tally)
    assert np.allclose(score, np.sort(x[:100] @ x.T, axis=1)[:, ::-1][:, :5])
    assert tally[0] < 0.2 * 100 * 2000
