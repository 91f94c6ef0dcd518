"""The corpus pipeline on a small folder, stage by stage against brute force."""
import collections
import os
import re
import sys

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANKS = " \t\n\v\f\r"


def dedup(rows):
    key = lambda line: line.strip(BLANKS).translate(FOLD)
    held = collections.defaultdict(set)
    for i, t in rows.items():
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(i)
    gone = lambda i, line: len(held.get(key(line), ())) >= 3 and i != max(held[key(line)])
    return {i: "\n".join(x for x in (t or "").split("\n") if not gone(i, x)) for i, t in rows.items()}


def one_of_each(rows):
    sets, comp = {}, {i: i for i in rows}
    for i, t in rows.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and comp[a] > comp[b]:
                    comp[a], changed = comp[b], True
    return {i: t for i, t in rows.items() if comp[i] == i}


def clean(rows, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    runs = lambda w, n: {tuple(w[k:k + n]) for k in range(len(w) - n + 1)}
    wins = [(min(10, len(w)), runs(w, min(10, len(w)))) for w in map(words, items) if w]
    return {i: t for i, t in rows.items() if not any(runs(words(t), n) & s for n, s in wins)}


def test_pipeline(spark, tmp_path, monkeypatch):
    import corpus_pipeline as cp
    from slipway.llm import packing, toxicity
    rng = np.random.default_rng(7)
    some = lambda n, at=0: " ".join(f"w{at + k}" for k in rng.integers(0, 400, n))
    line, item = "A line that several documents share", some(14, 5000)
    text = {i: some(30) + "\n" + some(12) for i in range(70)}
    for i in range(70, 110):
        text[i] = "vile hateful scum " * 5 + some(6)
    for i in (3, 8, 13):
        text[i] = f"{text[i]}\n  {line.upper() if i == 8 else line}\ntail {i}"
    for i in (20, 21):
        text[i + 100] = text[i].replace("\n", " ")  # copies but for the blanks
    text[130] = text[30] + " more"
    text[40] += f"\nbefore {item.replace(' ', ', ')} after"
    text[43] += "\nends with a Short, one"
    text[141], text[142], text[143] = None, "", "short one"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1.0) for i, t in text.items()],
                                 "doc_id long, text string, lang string, source string, n_chars long, score double")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, 1, int(70 <= i < 110)) for i in range(110)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item), (2, "short one")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    wrote, keep = [], cp.stored
    monkeypatch.setattr(cp, "stored", lambda df, name: wrote.append(keep(df, name)) or wrote[-1])
    packed = cp.run(spark, str(tmp_path)).collect()
    got = [{r["doc_id"]: r["text"] for r in df.collect()} for df in wrote]
    assert all(df.columns == docs.columns for df in wrote) and len(got) == 4

    bad = {r["doc_id"] for r in toxicity.scores(docs, labels).collect() if r["predicted"] == 1}
    # Texts of which the classifier knows no gram score by its intercept alone.
    assert bad - {141, 142, 143} == set(range(70, 110))
    want = {i: t for i, t in text.items() if i not in bad}
    assert got[0] == want
    want = dedup(want)
    assert {i: t or "" for i, t in got[1].items()} == want and want[3] != text[3] and want[13] == text[13]
    want = one_of_each(want)
    assert {i: t or "" for i, t in got[2].items()} == want and not {120, 121, 130} & set(want)
    want = clean(want, [item, "short one"])
    assert {i: t or "" for i, t in got[3].items()} == want and not {40, 43} & set(want)

    tok = packing.Encoder(packing.tokenizer_path()).tok
    n = {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in want.items()}
    assert {r["doc_id"]: r["length"] for r in packed} == n and len(packed) == len(n)
    seqs = collections.Counter()
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == seqs[r["sequence_id"]]
        seqs[r["sequence_id"]] += r["length"]
    assert max(seqs.values()) <= packing.SEQ
