"""Operators of the corpus package on small tables: edge cases and brute force."""
import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from slipway.llm import (
    annsearch, chat, ctw, decontaminate, linededup, ngramjoin, packing, quality, resharding, toxicity)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double"
WORDS = [f"w{i}" for i in range(300)]


def rows(texts):
    return [(i, t, "en", "s", 0, 1.0) for i, t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    long = " ".join(WORDS)
    near = " ".join(WORDS[:290] + ["x"] * 10)
    line = "This line is shared by three documents"
    return spark.createDataFrame(rows([
        (1, None), (2, ""), (3, " \n "), (4, long), (5, long), (6, near), (7, "a b"), (8, "A b"),
        (9, f"{line}\none"), (10, f"two\n  {line.upper()} "), (11, f"{line}\n{line}"), (None, "no id here"),
        (12, "short"), (12, "short")]), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_escape_round_trip():
    for t in ("", "<|im_end|>", "<\\|x", "<<||", "<\\\\|im_start|>", "é<|"):
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)
    assert chat.unescape_role(chat.escape_role("a\n\\n<|b")) == "a\n\\n<|b"


def test_chat(spark):
    conv = spark.createDataFrame([(1, 1, "assistant", chat.PROBE), (1, 0, "user", None), (2, 0, "assistant", "x"),
                                  (3, 0, None, "y")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.segments(conv)).collect()}
    want = hashlib.sha256(f"user\n\nassistant\n{chat.PROBE}\n".encode()).hexdigest()
    assert got[1]["turns_sha256"] == want and got[1]["loss_chars"] == len(chat.PROBE) and got[1]["valid"]
    assert not got[2]["valid"] and got[3]["n_turns"] == 1 and got[3]["loss_chars"] == 0
    assert chat.read_back(chat.segments(conv.limit(0))).count() == 0


def test_min_cost_flow():
    flow = resharding.min_cost_flow([10, 0, 5], [5, 5, 5])
    assert sum(f for (i, j), f in flow.items() if i != j) == 5
    rng = np.random.default_rng(0)
    for _ in range(20):
        a = rng.integers(0, 50, 5).tolist()
        b = rng.multinomial(sum(a), [1 / 4] * 4).tolist()
        flow = resharding.min_cost_flow(a, b)
        assert [sum(f for (i, _), f in flow.items() if i == k) for k in range(5)] == a
        assert [sum(f for (_, j), f in flow.items() if j == k) for k in range(4)] == b
        stay = sum(min(x, y) for x, y in zip(a, b))
        assert sum(f for (i, j), f in flow.items() if i != j) == sum(a) - stay


def test_reshard(docs, none, tmp_path):
    old = F.pmod(F.crc32(F.coalesce(F.col("doc_id"), F.lit(0)).cast("string").cast("binary")), F.lit(3))
    out = resharding.assign(docs, old, 3, [1.0] * 4)
    got = out.collect()
    assert len(got) == docs.count()
    for s in {r["_shard"] for r in got}:
        assert sorted(r["_slot"] for r in got if r["_shard"] == s) == list(range(sum(r["_shard"] == s for r in got)))
    hit = resharding.rewrite(out, str(tmp_path / "t"), ["doc_id", "text"])
    back = docs.sparkSession.read.parquet(str(tmp_path / "t"))
    assert back.count() == sum(r["_shard"] in hit for r in got)
    assert resharding.assign(none, old, 3, [1.0] * 4).count() == 0


def test_reshard_over_old_files(spark, tmp_path):
    path = str(tmp_path / "t")
    data = [(i, "x" * (i % 7) if i % 11 else None, i % 6) for i in range(300)]
    df = spark.createDataFrame(data, "doc_id long, text string, _shard int")
    df.withColumnRenamed("_shard", "shard").write.partitionBy("shard").parquet(path)
    for n_old, shares in ((6, [1.0] * 4), (4, [1.0, 0.0, 1.0, 1.0]), (4, [1.0] * 5)):  # a shrink, no capacity, growth
        old = spark.read.schema("doc_id long, text string, shard int").parquet(path)
        out = resharding.assign(old, F.col("shard"), n_old, shares)
        want = sorted((r["doc_id"], r["text"] or "", r["_shard"]) for r in out.collect())
        resharding.rewrite(out, path, ["doc_id", "text"])
        back = spark.read.schema("doc_id long, text string, shard int").parquet(path).collect()
        assert sorted((r["doc_id"], r["text"] or "", r["shard"]) for r in back) == want and len(want) == 300
        assert {int(p.name[6:]) for p in (tmp_path / "t").glob("shard=*")} == {j for j, x in enumerate(shares) if x}


def test_reshard_query_reads_its_files(spark, docs, none, tmp_path, monkeypatch):
    wrote = []
    rewrite = resharding.rewrite
    monkeypatch.setattr(resharding, "rewrite", lambda a, path, names: wrote.append(path) or rewrite(a, path, names))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = resharding.op4_mincost_reshard(spark, str(tmp_path)).collect()
    files = [r["shard"] for r in spark.read.parquet(wrote[0]).collect()]
    assert files and len(files) == sum(r["shard"] in files for r in got)
    assert all(r["shard"] in files for r in got if r["shard"] != r["old_shard"])
    want = [(r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect()]
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["size"], r["text_crc32"])) for r in got)
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    (tmp_path / "none").mkdir()
    none.write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert resharding.op4_mincost_reshard(spark, str(tmp_path / "none")).count() == 0


def test_line_dedup(spark, docs, none):
    got = {r["doc_id"]: r for r in linededup.rewrite(docs).select("doc_id", "text").collect()}
    assert got[9]["text"] == "one" and got[10]["text"] == "two" and got[11]["text"].count("\n") == 1
    assert linededup.rewrite(docs).columns == docs.columns and linededup.rewrite(none).count() == 0
    state = linededup.insert(linededup.empty_state(spark), docs.filter("doc_id <> 9"))
    more = linededup.insert(state, docs.filter("doc_id = 9"))
    assert more["filters"].agg(F.sum("n_keys")).first()[0] == 1
    less = linededup.delete(more, spark.createDataFrame([(9,)], "doc_id long"))
    assert sorted(map(str, less["refs"].collect())) == sorted(map(str, state["refs"].collect()))
    assert less["filters"].agg(F.sum("n_keys")).first()[0] == 0


def test_cuckoo():
    keys = np.frombuffer(b"".join(hashlib.blake2b(bytes([i % 256, i // 256]), digest_size=16).digest()
                                  for i in range(2000)), np.uint8).reshape(-1, 16)
    f = linededup.Cuckoo.sized(2000)
    assert f.insert(keys[:1500]) and f.contains(keys[:1500]).all()
    f.delete(keys[:700])
    assert f.contains(keys[700:1500]).all() and f.contains(keys[:700]).mean() < 0.01 and f.n_keys == 800


def brute_groups(texts):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold))
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                n = len(sets[a] & sets[b])
                if n and 100 * n >= 75 * len(sets[a] | sets[b]) and comp[a] > comp[b]:
                    comp[a], changed = comp[b], True
    return {i: (len(sets[i]), comp[i]) for i in sets}


def test_ngram_join(spark, docs, none):
    rng = np.random.default_rng(1)
    base = [WORDS[k] for k in rng.integers(0, 300, 80)]
    texts = [(i, " ".join(base[:k] + [f"z{i}"] + base[k + 1:])) for i, k in enumerate(rng.integers(0, 80, 40))]
    texts += [(100 + i, " ".join(base[:20 + i])) for i in range(0, 60, 3)]
    got = ngramjoin.groups(spark.createDataFrame(rows(texts), DOCS)).collect()
    assert {r["id"]: (r["size"], r["comp"]) for r in got} == brute_groups(texts)
    own = {r["id"]: (r["size"], r["comp"]) for r in ngramjoin.groups(docs).collect()}
    assert own[1] == (0, 1) and own[2] == (0, 2) and own[5][1] == 4 and own[6][1] == 4 and own[8][1] == 7
    assert ngramjoin.groups(none).count() == 0
    assert ngramjoin.keep_one(docs).columns == docs.columns


def test_ngram_join_counts_all_links(spark, docs, none, monkeypatch, tmp_path):
    rng = np.random.default_rng(5)
    base = [WORDS[k] for k in rng.integers(0, 300, 90)]
    texts = [(i, " ".join(base[:k] + [f"z{i}"] + base[k + 1:])) for i, k in enumerate(rng.integers(0, 90, 70))]
    texts += [(100 + i, " ".join(base[:15 + i])) for i in range(0, 75, 2)]
    texts += [(300 + i, texts[i][1]) for i in range(5)] + [texts[0], (400, "a b"), (401, "A  b"), (402, None), (403, "c d")]
    texts += [(404, "one text of this id"), (404, "a b")]
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = []
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold))
        own.append((i, frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    want = sorted((i, len(s), sum(100 * len(s & o) >= 75 * len(s | o) for j, o in set(own) - {(i, s)} if o and s))
                  for i, s in own)
    spark.createDataFrame(rows(texts), DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    for size, dense in ((256, 1024), (16, 4)):  # one block a component, several with dense columns
        monkeypatch.setattr(ngramjoin, "BLOCK_CLASSES", size)
        monkeypatch.setattr(ngramjoin, "DENSE_PAIRS", dense)
        got = ngramjoin.op3_ngram_join(spark, str(tmp_path)).collect()
        assert sorted((r["doc_id"], r["n_shingles"], r["n_links"]) for r in got) == want, size
    assert max(n for _, _, n in want) > 20
    assert ngramjoin.counted(none).count() == 0
    assert {r["id"]: r["n_links"] for r in ngramjoin.counted(docs).collect() if r["id"] in (1, 4, 5, 6, 7)} == {
        1: 0, 4: 2, 5: 2, 6: 2, 7: 1}


def test_decontaminate(spark, docs, none):
    bench = spark.createDataFrame([(1, " ".join(WORDS[40:60])), (2, "no such words at all in any of the other documents"),
                                   (3, "A, B!"), (4, None)], "item_id long, text string")
    got = {}
    for r in decontaminate.report(docs, bench).collect():
        got[r["doc_id"]] = r
    assert got[4]["n_hit"] == 20 and got[4]["n_items"] == 1 and got[6]["n_hit"] == 20
    assert got[7]["n_hit"] == 2 and got[8]["n_hit"] == 2 and not got[1]["contaminated"] and got[None]["n_words"] == 3
    assert decontaminate.report(none, bench).count() == 0
    assert decontaminate.report(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.keep_clean(docs, bench).count() == docs.count() - 5


def test_decontaminate_final_sigma(spark):
    # Lower-casing a whole text makes the last letter of the word a final sigma or not, by what follows.
    own = ["\u039f\u0394\u039f\u03a3", *WORDS[:3], "\u03a6\u03a9\u03a3", *WORDS[3:6], "\u03a4\u039f\u03a3", "\u0391"]
    bench = spark.createDataFrame([(1, " ".join(own)), (2, "\u039d\u039f\u03a3 \u0391")], "item_id long, text string")
    docs = spark.createDataFrame(rows([(1, "x " + ".".join(own) + " y"), (2, " ".join(own)), (3, "\u039d\u039f\u03a3.\u0391"),
                                       (4, " ".join(own).lower())]), DOCS)
    got = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in decontaminate.report(docs, bench).collect()}
    assert got == {1: (10, 1), 2: (10, 1), 3: (2, 1), 4: (0, 0)}
    assert [r["doc_id"] for r in decontaminate.keep_clean(docs, bench).collect()] == [4]


def test_packing(docs, none):
    got = packing.pack(packing.pieces(docs, ["doc_id"], seq=64, with_ids=True), seq=64, group=8).collect()
    assert sum(r["length"] for r in got if r["doc_id"] == 1) == 1
    for r in got:
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
    for s in {r["sequence_id"] for r in got}:
        at = 0
        for r in sorted((r for r in got if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    assert packing.pack(packing.pieces(none, ["doc_id"])).count() == 0
    rng = np.random.default_rng(2)
    size = rng.integers(1, 101, 3000)
    bins, _ = packing.best_two_fit(size, 100)
    assert np.bincount(bins, size).max() <= 100 and bins.max() + 1 <= 1.02 * -(-size.sum() // 100)


def test_packing_encodes_chunks_as_whole_texts():
    import sys
    enc = packing.Encoder(packing.tokenizer_path())
    letters = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isalpha() and (ord(c) < 0x3000 or 0xF900 <= ord(c) < 0x20000)]
    assert {"\u0130", "\u0958", "\u09dc", "\ufb2a"} <= set(letters)
    marks = ["\u0301", "\u0307", "\u0323\u0301", "\u05b7", "\u093c"]
    words = [*letters, *(f"ab{c}" for c in letters), *(f"{c}ab" for c in letters), *(a + m for a in "aIZ\u0915\u05e9" for m in marks),
             "don't", "IT'S", "x1", "<|endoftext|>", "a\tb", "\u212a", "\u03a3"]
    chunks = [w + sign for w in words for sign in (",", ".", "..", ",.", "")]
    whole = enc.tok.encode_batch(chunks, add_special_tokens=False)
    wrong = [c for c, w in zip(chunks, whole) if enc[c] != np.array(w.ids, "<u4").tobytes()]
    assert not wrong, wrong[:20]
    for text in ("\u0130, \u0958. \u09dc,\n\ufb2a.", "A dog, a \u0130. \u0301x, \n \u0301, end."):
        assert enc.text(text) == np.array(enc.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes() + packing.END


def test_models_on_edge_cases(spark, docs, none):
    labels = spark.createDataFrame([(4, 1, 0), (7, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for fn in (toxicity.scores, quality.scores):
        out = fn(docs, labels).collect()
        assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
        assert fn(docs, labels.limit(0)).count() == docs.count() and fn(none, labels).count() == 0
    got = ctw.scores(docs).collect()
    assert len(got) == docs.count() and all(r["score"] <= 0 for r in got) and ctw.scores(none).count() == 0
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}


def test_context_tree_is_a_distribution():
    cell = np.unique(np.concatenate([ctw.word_cells(w) for w in (b"ab", b"abc", b"b")]))
    start = cell[0] & ~np.uint64(255)
    every = np.unique(np.concatenate([cell, start | np.arange(256, dtype=np.uint64)]))
    n = np.where(np.isin(every, cell), 3, 0)
    p = np.ones(len(every))
    for _, bit, q, _, _, _ in ctw._subtree(every, n, 0):
        p *= np.where(bit == 1, q, 1 - q)
    assert abs(p[(every & ~np.uint64(255)) == start].sum() - 1) < 1e-9


def test_context_tree_matches_every_byte_read_in_turn(spark):
    texts = ["the cat sat on a mat", "The Cat  sat", "a", None, "", "\u00e9 caf\u00e9\ta\nb", "nul \x00 x\x00y"]
    data = [(i, texts[i % len(texts)]) for i in range(60)]
    got = {r["doc_id"]: r for r in ctw.scores(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert len(got) == 60 and {r["held_out"] for r in got.values()} == {True, False}

    def cells(text):  # every byte with the seven before it, as the docstring defines them
        before = b""
        for w in [*re.findall(rb"[^\x20\x09-\x0D]+", (text or "").lower().encode()), None]:
            tail, own = before[-ctw.TAIL:], (w + b" " if w else b"\xff")
            for j, b in enumerate(own):
                ctx = (bytes(7) + (tail if j < ctw.START else b"") + b" " + own[:j])[-7:]
                yield int.from_bytes(ctx[::-1] + bytes([b]), "big")
            before = w

    train = collections.Counter()
    for i, t in data:
        if not got[i]["held_out"]:
            train.update(cells(t))
    every = np.array(sorted({c for t in texts for c in cells(t)}), np.uint64)
    n = np.array([train[int(c)] for c in every], float)
    lp = np.zeros(len(every))
    for _, bit, q, _, _, _ in ctw._subtree(every, n, 0):
        lp += np.log10(np.where(bit == 1, q, 1 - q))
    at = {int(c): v for c, v in zip(every, lp)}
    for i, t in data:
        assert abs(got[i]["score"] - sum(at[c] for c in cells(t))) < 1e-6, t


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6))
    x[100:160] = x[100]
    data = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    data += [(900, None), (901, [0.0] * 6), (902, [float("nan")] * 6), (None, [1.0] * 6), (940, [None] * 6)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = annsearch.neighbours(df, F.col("vec_id") % 20 == 0, factor=1.0).collect()
    for q in range(0, 400, 20):
        s = x @ x[q]
        want = [int(i) for i in np.lexsort((np.arange(400), -np.round(s, 9))) if i != q][:20]
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want
    assert {r["query_id"] for r in got} == set(range(0, 400, 20))
    assert annsearch.neighbours(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
