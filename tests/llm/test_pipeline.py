"""The pipeline's run() against a version that works row by row and by all pairs, on the small tables with rows that are hard to tell apart."""

import collections
import hashlib
import math
import os
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillstone.llm import minhash, pii, quality

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the small tables are not here")


def brute_sets(texts):
    """The damped counts of each text's shingles."""
    out = []
    for t in texts:
        _, h, c = minhash.weighted_shingles(*minhash.utf8(pa.array([t.lower()])))
        out.append({int(x): 1 + math.log(int(n)) for x, n in zip(h, c, strict=True)})
    return out


def weighted_jaccard(a, b, idf):
    w = lambda x: idf[x >> (44 - minhash.IDF_BITS)]
    low = sum(min(a.get(x, 0), b.get(x, 0)) * w(x) for x in a.keys() | b.keys())
    high = sum(max(a.get(x, 0), b.get(x, 0)) * w(x) for x in a.keys() | b.keys())
    return low / high if high else 0.0


def brute_keep_one(rows):
    texts = sorted({r["text"] or "" for r in rows})
    sets = brute_sets(texts)
    counts = np.zeros(1 << minhash.IDF_BITS, np.int64)
    of = dict(zip(texts, sets, strict=True))
    for r in rows:  # a count for each row and each of its shingles
        for x in of[r["text"] or ""]:
            counts[x >> (44 - minhash.IDF_BITS)] += 1
    idf = minhash.idf_table(counts, len(rows)).astype(float)
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if min(len(sets[i]), len(sets[j])) * 4 >= max(len(sets[i]), len(sets[j])) and weighted_jaccard(sets[i], sets[j], idf) >= 0.8:
                parent[root(i)] = root(j)
    least = collections.defaultdict(list)
    for r in rows:
        text = r["text"] or ""
        least[root(texts.index(text))].append((r["doc_id"] is None, r["doc_id"] or 0, text))
    chosen = {}
    for k, members in least.items():
        ids = collections.defaultdict(list)
        for none, i, text in members:
            ids[text].append((none, i))
        chosen[k] = min((*min(x), hashlib.md5(t.encode()).hexdigest(), t) for t, x in ids.items())
    return {(None if none else i, t) for none, i, _, t in chosen.values()}


def brute_mix(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = collections.Counter()
    for r in rows:
        sources[r["source"]] += size(r["text"])
    order = sorted(sources, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, total = {}, set(order), float(sum(sources.values()))
    while left:
        level = (total - sum(target.values())) / sum(weight[s] for s in left)
        full = {s for s in left if level * weight[s] > 3 * sources[s]}
        if not full:
            target |= {s: level * weight[s] for s in left}
            break
        target |= {s: 3.0 * sources[s] for s in full}
        left -= full
    return sources, target


def test_run_against_brute_force(spark, tmp_path):
    db = duckdb.connect()
    docs = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in db.execute(f"select doc_id, text, lang, source, n_chars from '{SF}/documents.parquet' where length(text) < 6000 order by doc_id").fetchall()]
    good = [r for r in docs if 900 < len(r["text"]) < 2500][:12]
    docs += [dict(good[0], doc_id=None), dict(good[1], doc_id=None, source="other"), dict(good[2], text=good[3]["text"] + " and more", source=None), dict(good[4]), dict(good[5], doc_id=good[6]["doc_id"]), dict(good[7], text=good[7]["text"] + " changed")]
    docs += [{"doc_id": 9000 + i, "text": t, "lang": None, "source": None, "n_chars": None} for i, t in enumerate((None, "", good[8]["text"].replace(" ", "  ")))]
    frame = spark.createDataFrame([tuple(r.values()) for r in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame = frame.select("*", *[F.lit(7).alias(c) for c in ("score", "leaks", "size", "taken", "copies", "target", "row", "text_key", "id", "none", "rows", "key")])
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    read = lambda t: spark.read.parquet(f"{tmp_path}/{t}.parquet")
    machine = quality.train(read("documents"), read("labels"))
    rows = [r for r in docs if machine.score(pa.array([r["text"] or ""]))[0] >= 0.7]
    assert 100 < len(rows) < len(docs)
    kept = brute_keep_one(rows)
    once = []
    for r in rows:
        if (r["doc_id"], r["text"] or "") in kept:
            kept.discard((r["doc_id"], r["text"] or ""))
            once.append(r)
    assert not kept and len(once) < len(rows)
    items = [w.lower().split() for (w,) in db.execute(f"select text from '{SF}/benchmark.parquet'").fetchall()]
    runs = {tuple(w[k : k + 8]) for w in items for k in range(len(w) - 7)}
    clean = [r for r in once if not any(tuple(w[k : k + 8]) in runs for w in [(r["text"] or "").lower().split()] for k in range(len(w) - 7))]
    assert len(clean) < len(once)
    # the tagger of the stage is trained on what the stage before kept
    finder = pii.Finder(pii.train(spark.createDataFrame([(r["text"],) for r in clean], "text string")))
    for r in clean:
        if r["text"] is not None:
            base = pii.base_spans(r["text"])
            r["text"] = pii.redact_text(r["text"], sorted(base + finder.added([r["text"]], [base])[0]))
            r["n_chars"] = len(r["text"])
    sources, target = brute_mix(clean)
    names = ("doc_id", "text", "lang", "source", "n_chars")
    every = {tuple(r[n] for n in names) for r in clean}
    taken = collections.Counter()
    for r in got:
        assert tuple(r[n] for n in names) in every
        assert r["size"] == 7 and r["_size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) and 1 <= r["_copies"] <= 3 and r["_taken"] == r["_size"] * r["_copies"]
        assert abs(r["_target"] - target[r["source"]]) < 1e-6
        taken[r["source"]] += r["_taken"]
    assert len({tuple(r[n] for n in names) for r in got}) == len(got)
    for s in sources:
        share = target[s] / sources[s] if sources[s] else 0
        drawn = [r for r in got if r["source"] == s]
        n = sum(r["source"] == s for r in clean)
        assert abs(sum(r["_copies"] for r in drawn) - share * n) <= 1 + 1e-6, s
