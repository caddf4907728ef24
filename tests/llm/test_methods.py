"""The operators against brute force, exact round trips or held-out accuracy on the small tables."""

import collections
import math
import os
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillstone.llm import decontaminate, embed_dedup, graph, html_template, minhash, pii, quality, queries, suffix_tree, warc, words
from quillstone.llm.tagger import Tagger

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the small tables are not here")


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(f"{SF}/documents.parquet").to_pandas()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels", "benchmark"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = db.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(str(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(map(str, want.fetchall()))


def test_words_depend_on_the_word_alone():
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("ab é-\n"), n)) for n in rng.integers(0, 60, 50)] + ["x" * 1_200_000 + " tail end " + "y " * 400_000, None]
    h, s, e, first = words.hash_words(*words.utf8(pa.array(texts)), words.SPACE_WORDS)
    for i, t in enumerate(texts):
        parts = (t or "").encode().lower().split()
        assert len(parts) == first[i + 1] - first[i]
        if len(parts) < 100:
            assert [words.word_hash(p.decode(), words.SPACE_WORDS) for p in parts] == h[first[i] : first[i + 1]].tolist()


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(i, i + 1) for i in range(200, 260)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.id: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for e in edges for x in e if e[0] != e[1]}
    assert got == {x: root(x) for x in linked}


def weighted_classes(texts):
    """Components over all pairs of weighted Jaccard similarity 0.8 or more, and the similarities, in plain numpy."""
    rows = []
    counts = np.zeros(1 << minhash.IDF_BITS, np.int64)
    for t in texts:
        _, h, c = minhash.weighted_shingles(*words.utf8(pa.array([t.lower()])))
        counts += np.bincount(minhash.bucket_of_shingle(h), minlength=1 << minhash.IDF_BITS)
        rows.append((h, c))
    idf = minhash.idf_table(counts, len(texts)).astype(float)
    weights = [dict(zip(h.tolist(), (minhash.damped(c) * idf[minhash.bucket_of_shingle(h)]).tolist(), strict=True)) for h, c in rows]
    totals, owners = [sum(w.values()) for w in weights], collections.defaultdict(list)
    for i, w in enumerate(weights):
        for h in w:
            owners[h].append(i)
    parent, near = list(range(len(texts))), {}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, w in enumerate(weights):
        low = collections.Counter()
        for h, x in w.items():
            for j in owners[h]:
                if j < i:
                    low[j] += min(x, weights[j][h])
        for j, x in low.items():
            near[j, i] = x / (totals[i] + totals[j] - x)
            if near[j, i] >= 0.8 - 1e-9:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(texts))], near, idf


def test_near_duplicates_against_all_pairs(spark, docs):
    """Exactly the classes that all pairs give: none lost, none that are not near joined."""
    want, _, _ = weighted_classes(list(docs.text))
    ids = docs.doc_id.tolist()
    least = {}
    for i, c in zip(ids, want, strict=True):
        least[c] = min(i, least.get(c, i))
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(docs[["doc_id", "text"]])).collect()}
    assert got == {i: least[c] for i, c in zip(ids, want, strict=True)}


@pytest.mark.parametrize(("families", "members"), [(3, 2), (10, 5), (50, 10)])
def test_buckets_of_mixed_groups(spark, families, members):
    """6, 50 and 500 texts that share a long passage, in families of near copies in chains: the classes of all pairs."""
    rng, rows = np.random.default_rng(families), []
    passage = [f"w{i}" for i in range(140)]
    for f in range(families):
        w = [*passage, *(f"f{f}x{k}" for k in range(70))]
        for m in range(members):
            w = list(w)
            for k in rng.integers(142, 208, 2):
                w[k] = f"g{f}m{m}x{k}"
            rows.append(" ".join(w))
    want, near, _ = weighted_classes(rows)
    assert len(set(want)) < len(rows) and max(v for (a, b), v in near.items() if want[a] != want[b]) > 0.3
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert sum(got[i] == c for i, c in enumerate(want)) >= 0.97 * len(rows)  # what shares no band may be missed
    assert all(want[i] == want[got[i]] for i in got)


def test_similarities_of_all_pairs():
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("abcdefg"), n)) for n in rng.integers(0, 60, 40)] + ["a b c d e " * 30, "a b c d e " * 25, ""]
    _, near, idf = weighted_classes(texts)
    got = minhash.similarities(pa.array(texts), idf)
    for i in range(len(texts)):
        for j in range(i):
            assert abs(got[i, j] - near.get((j, i), 0)) < 1e-9 and got[i, j] == got[j, i]
    a, b = zip(*near, strict=True)
    assert np.allclose(minhash._similarity(pa.array([texts[i] for i in a]), pa.array([texts[i] for i in b]), idf), list(near.values()))


def test_large_groups_stay_together(spark):
    """Copies of one text with a few words changed: all that are near to some other one end in one class, whatever the bucket's size."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):
        w = list(base)
        for j in rng.integers(0, 150, 1 + i % 2):
            w[j] = f"z{rng.integers(1 << 30)}"
        rows.append((i, " ".join(w)))
    other = [(1000 + i, " ".join(f"q{rng.integers(1 << 30)}" for _ in range(80)) + " " + " ".join(base[:10])) for i in range(60)]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows + other, "doc_id long, text string")).collect()}
    want, near, _ = weighted_classes([t for _, t in rows + other])
    links = sum(v >= 0.8 for v in near.values())
    assert 300 < links < 0.45 * len(rows) ** 2  # many, far from all pairs
    assert all(got[i] == want[i] for i in range(120))
    assert all(got[i] == i for i, _ in other)


def test_families_that_share_a_passage(spark, monkeypatch):
    """Pairs of near copies among many texts that share a long passage: found by the full comparison, whatever the shortcuts for large buckets meet."""
    monkeypatch.setattr(minhash, "DEPTH", 1)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    passage, rows = [f"w{i}" for i in range(400)], []
    for i in range(80):
        w = [*passage, *(f"f{i}x{k}" for k in range(70))]
        other = list(w)
        other[404:468:8] = [f"g{i}x{k}" for k in range(8)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(other))]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i // 2 * 2 for i in range(160)}


def test_consistent_samples_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 1 << 44, 400).astype(np.uint64)
    a, b = rng.gamma(2, 1, 400), rng.gamma(2, 1, 400)
    b[:300] = a[:300]
    sampler = minhash.Sampler(2048, 5)
    x = sampler.signatures(np.array([0]), keys, a)
    y = sampler.signatures(np.array([0]), keys, b)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((x == y).mean() - want) < 0.05


def test_suffix_tree_against_counts(spark, docs):
    out = {r.doc_id: r for r in suffix_tree.score_texts(spark.createDataFrame(docs[["doc_id", "text"]])).collect()}
    known, rows = collections.Counter(), 0
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        if zlib.crc32(str(i).encode()) % 10:
            known.update(t.encode().lower().split())
            rows += 1
    total, distinct = sum(known.values()) + rows, len(known) + 1
    f = lambda c: math.log10((c + 0.1) / (total + 0.1 * (distinct + 1)))
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        w = t.encode().lower().split()
        r = out[i]
        assert r.train_tokens == total and r.n_tokens == len(w) + 1 and r.n_known == sum(x in known for x in w) + 1
        assert abs(r.base_score - sum(f(known[x]) for x in w) - f(rows)) < 1e-6
        assert r.held_out == (zlib.crc32(str(i).encode()) % 10 == 0)
    # shuffled letters are less likely than the texts
    rng = np.random.default_rng(0)
    held = [t for i, t in zip(docs.doc_id, docs.text, strict=True) if out[i].held_out and len(t) > 300]
    noise = ["".join(rng.permutation(list(t))) for t in held]
    both = spark.createDataFrame([*((int(i), t) for i, t in zip(docs.doc_id, docs.text, strict=True)), *((10**6 + 10 * k, t) for k, t in enumerate(noise))], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in suffix_tree.score_texts(both).collect()}
    per_char = lambda s, t: s / len(t)
    real = np.mean([per_char(scores[i], t) for i, t in zip(docs.doc_id, docs.text, strict=True) if out[i].held_out and len(t) > 300])
    assert real > np.mean([per_char(scores[10**6 + 10 * k], t) for k, t in enumerate(noise)])


def brute_suffix_tree(train, held):
    """Scores by the definition: every context in a dictionary, tested, closed over suffixes, smoothed towards its suffix."""
    st = suffix_tree

    def stream(t):
        return [st.START] * st.DEPTH + [int(c) for c in st.CLASS[np.frombuffer(" ".join(re.split(r"[ \t-\r]+", t.strip(" \t\n\v\f\r"))).encode(), np.uint8)]] + [st.END]

    counts, singles = collections.defaultdict(collections.Counter), np.zeros(256)
    for t in train:
        s = stream(t)
        singles += np.bincount(st._FOLDED[np.frombuffer(t.encode(), np.uint8)], minlength=256)
        for i in range(st.DEPTH, len(s)):
            for d in range(st.DEPTH + 1):
                counts[tuple(s[i - d : i])][s[i]] += 1
    all_of = {c: sum(x.values()) for c, x in counts.items()}
    kept = {()}
    for c, x in counts.items():
        if c:
            saved = sum(n * math.log(n / all_of[c] / (counts[c[1:]][y] / all_of[c[1:]])) for y, n in x.items())
            if 2 * saved >= st.SIGNIFICANCE * len(x):
                kept |= {c[i:] for i in range(len(c))}

    def p(c, y):
        if not c:
            return (counts[()][y] + 0.5) / (all_of[()] + 0.5 * (st.SYMBOLS - 1))
        given = st.SMOOTHING * len(counts[c])
        return (counts[c][y] + given * p(c[1:], y)) / (all_of[c] + given)

    logs = st.byte_logs(singles)
    out = []
    for t in held:
        s, score = stream(t), float(logs[np.frombuffer(t.encode(), np.uint8)].sum(dtype=np.float64))
        for i in range(st.DEPTH, len(s)):
            c = tuple(s[i - st.DEPTH : i])
            while c not in kept:
                c = c[1:]
            score += math.log10(p(c, s[i]))
        out.append(score)
    return out, len(kept)


def test_suffix_tree_beats_its_base(spark):
    """On held-out texts the tree gives more than the words' own frequencies."""
    out = suffix_tree.score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").toPandas()
    assert out.score.sum() > out.base_score.sum()


@pytest.mark.parametrize("part", [10**9, 4000])
def test_suffix_tree_scores_against_brute_force(spark, docs, monkeypatch, part):
    """In one part and in many."""
    monkeypatch.setattr(suffix_tree, "PART", part)
    some = docs[docs.text.str.len() < 3000].head(120)
    held = np.array([zlib.crc32(str(i).encode()) % 10 == 0 for i in some.doc_id])
    want, n = brute_suffix_tree(list(some.text[~held]), list(some.text))
    assert n > 500
    got = {r.doc_id: r.score for r in suffix_tree.score_texts(spark.createDataFrame(some[["doc_id", "text"]])).collect()}
    assert all(abs(got[i] - w) < 1e-4 * max(1, abs(w)) for i, w in zip(some.doc_id, want, strict=True))


def test_small_language_keeps_its_contexts(spark):
    """What occurs thousands of times and diverges is a state, however large the rest of the corpus is."""
    rows = collections.Counter()
    for text, n in (("the same old words as ever", 10**10), ("qx", 3000)):
        data, offsets = words.utf8(pa.array([text]))
        _, s, _, first = words.hash_words(data, offsets, words.SPACE_WORDS)
        context, symbol, _ = suffix_tree.symbols(data, offsets, s, first)
        for c, y in zip(context.tolist(), symbol.tolist(), strict=True):
            rows[c << suffix_tree.BITS | y] += n
    found = suffix_tree.states(spark.createDataFrame(list(rows.items()), "key long, n long")).where("depth > 0").collect()
    assert any(r.symbol == suffix_tree.CLASS[ord("x")] and r.n == 3000 for r in found)


def test_patterns_against_regular_expressions():
    kinds = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")

    def brute(t):
        out = []
        for k, r in enumerate(kinds):
            for m in re.finditer(r, t):
                d = re.sub("[^0-9]", "", m[0])
                if (k == 1 and max(map(int, m[0].split("."))) > 255) or (k == 2 and not (14 <= len(d) <= 19 and pii.luhn(d))) or (k == 3 and not 10 <= len(d) <= 15):
                    continue
                out.append((m.start(), k, m.end()))
        return sorted(out)

    rng = np.random.default_rng(3)
    for _ in range(4000):
        t = "".join(rng.choice(list("a@.1234 -+()é"), rng.integers(0, 40), p=[0.1, 0.1, 0.15, 0.1, 0.1, 0.1, 0.1, 0.05, 0.05, 0.05, 0.04, 0.04, 0.02]))
        assert pii.base_spans(t) == brute(t), t
    card = "4111 1111-1111 1111"
    assert pii.base_spans(f"x {card} y") == [(2, 2, 21)]


def test_tagger_gradients_and_decoding():
    rng = np.random.default_rng(1)
    t = Tagger.new(6, 3)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    x, y = rng.integers(0, 6, (2, 5)), rng.integers(0, 3, (2, 5))
    _, g = t.gradients(x, y)
    for k in ("uf", "wb", "tr", "st", "o", "e", "bb"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        for sign in (1, -1):
            t.p[k][at] += sign * 1e-5
            if sign == 1:
                up = t.gradients(x, y)[0]
                t.p[k][at] -= 1e-5
            else:
                down = t.gradients(x, y)[0]
                t.p[k][at] += 1e-5
        assert abs((up - down) / 2e-5 - g[k][at]) < 1e-4 * max(1, abs(g[k][at])), k
    em = t.emissions(x)
    import itertools

    for i in range(2):
        best = max(itertools.product(range(3), repeat=5), key=lambda p: t.p["st"][p[0]] + sum(em[s, i, p[s]] for s in range(5)) + sum(t.p["tr"][a, b] for a, b in zip(p, p[1:], strict=False)))
        assert t.decode(x)[i].tolist() == list(best)


def test_tagger_learns_held_out_forms():
    tagger = Tagger.new(pii.SYMBOLS, 9)
    sets = [pii._written(np.random.default_rng(s), n) for s, n in ((2, 700), (99, 150))]
    x, y = [], []
    for text, spans in sets[0]:
        p = pii.code_points(text)
        x.append(pii.cut(pii.encode(p), np.zeros(1, np.int64))[0])
        y.append(np.concatenate([pii.tags_of(spans, len(p)), np.zeros(pii.WINDOW, np.int8)])[: pii.WINDOW])
    tagger.fit(np.stack(x).astype(np.int64), np.stack(y).astype(np.int64), epochs=10)
    found = pii.Finder(tagger).added([t for t, _ in sets[1]], [[] for _ in sets[1]])
    want = {(i, s, e) for i, (_, spans) in enumerate(sets[1]) for s, _, e in spans}
    got = {(i, s, e) for i, spans in enumerate(found) for s, _, e in spans}
    assert len(got & want) > 0.7 * len(want) and len(got - want) < 0.1 * len(got)


def other_forms(rng):
    """Numbers and addresses as people of another hand write them: none of these makers is used in training."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    names = ["maria", "jürgen", "ok", "sales", "info", "x"]
    card = "5" + d(14)
    card += next(c for c in "0123456789" if pii.luhn(card + c))
    return [
        (0, f"{rng.choice(names[3:])}{d(4)}@mail-{d(1)}.example.co"), (1, f"{rng.integers(1, 255)}.{rng.integers(0, 9)}.{rng.integers(0, 255)}.{rng.integers(10, 99)}"),
        (2, f"{card[:4]}.{card[4:8]}.{card[8:12]}.{card[12:]}"), (3, f"({d(3)}) {d(3)}-{d(4)}"), (3, f"{d(3)}-{d(3)}-{d(4)}"), (-1, f"v{d(1)}.{d(1)}.{d(2)}"), (-1, f"19{d(2)}/{d(2)}"), (-1, f"{d(2)} kg"),
    ]


def test_detection_end_to_end(spark, docs):
    """A tagger trained on the small tables, over texts from another generator: the patterns' spans exactly, most of the other forms, hardly anything else."""
    rng, rows, want = np.random.default_rng(17), [], {}
    for i in range(120):
        text, spans = "we met at the old station and said", []
        for _ in range(3):
            forms = other_forms(rng)
            kind, form = forms[rng.integers(0, len(forms))]
            text += " "
            if kind >= 0:
                spans.append((len(text), kind, len(text) + len(form)))
            text += form + rng.choice([" and then", ", or", ". After that"])
        rows.append((i, text))
        want[i] = spans
    tagger = pii.train(spark.createDataFrame(docs[["doc_id", "text"]]))
    got = {r.doc_id: {(int(s), pii.KINDS.index(k), int(e)) for k, s, e in (x.split(":") for x in r.spans.split(",") if x)} for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string"), tagger).collect()}
    every, found = {(i, *x) for i, s in want.items() for x in s}, {(i, *x) for i, s in got.items() for x in s}
    assert {(i, *x) for i, t in rows for x in pii.base_spans(t)} <= found
    assert len(every & found) >= 0.75 * len(every) and len(found - every) <= 0.15 * len(found)


def test_a_million_keys():
    from quillstone.llm.url_filter import DigestArray

    entry = lambda i: f"host{i}.example/{i % 7}"
    index = DigestArray.build((entry(i % 999_000), 1 + i % 2) for i in range(1_000_000))  # the last thousand repeat the first
    assert (np.diff(index.keys.astype(object)) >= 0).all() and len(index.keys) < 1_000_000
    wanted = [entry(i).encode() for i in range(0, 999_000, 999)]
    assert (index.probe(wanted) > 0).all() and not index.probe([w + b"x" for w in wanted]).any()


def test_leaks_are_those_planted(spark, docs):
    items = pq.read_table(f"{SF}/benchmark.parquet").to_pandas()
    runs = {}
    for i, t in zip(items.item_id, items.text, strict=True):
        w = t.lower().split()
        for k in range(len(w) - 7):
            runs[" ".join(w[k : k + 8])] = i
    want = {(d, runs[r]) for d, t in zip(docs.doc_id, docs.text, strict=True) for w in [t.lower().split()] for k in range(len(w) - 7) if (r := " ".join(w[k : k + 8])) in runs}
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(spark.createDataFrame(docs[["doc_id", "text"]]), spark.createDataFrame(items)).collect()}
    assert got == want


def test_paraphrases_are_found(spark, docs):
    items = pq.read_table(f"{SF}/benchmark.parquet").to_pandas()
    rng, rows = np.random.default_rng(0), []
    hosts = [t for t in docs.text if len(t) > 2000][:20]
    for k, (i, t) in enumerate(list(zip(items.item_id, items.text, strict=True))[:20]):
        w = t.split()
        if len(w) < 20:
            continue
        for j in rng.choice(len(w), max(1, len(w) // 10), replace=False):
            w[j] = f"changed{j}"
        body = hosts[k % len(hosts)].split()
        rows.append((10_000 + i, " ".join([*body[:90], *w, *body[90:]])))
    every = spark.createDataFrame([*((int(a), b) for a, b in zip(docs.doc_id, docs.text, strict=True)), *((int(a), b) for a, b in rows)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(every, spark.createDataFrame(items)).where("doc_id >= 10000").collect()}
    assert len(got & {(i, i - 10_000) for i, _ in rows}) >= 0.9 * len(rows)


def test_candidate_search_against_all_passages(spark):
    """Recall of the latent search against every passage compared on its words, on texts and on items of which 20 to 40 % of the words are changed."""
    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"])
    items = pq.read_table("/root/testdata/sf0.01/benchmark.parquet").to_pandas()
    rng, texts = np.random.default_rng(7), [t for t in docs["text"].to_pylist() if len(t) < 8000][:300]
    for t in items.text:
        w, host = t.split(), texts[rng.integers(0, 300)].split()
        for j in rng.choice(len(w), int(len(w) * rng.uniform(0.2, 0.4)), replace=False):
            w[j] = host[rng.integers(0, len(host))] if host else "x"
        texts.append(" ".join([*host[:50], *w, *host[50:]]))
    lower = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", F.lower("text").alias("text"))
    space = decontaminate.fit_space(lower)
    data, offsets = words.utf8(pa.array([t.lower() for t in texts]))
    found = []
    for cosine, slack in ((decontaminate.COSINE, decontaminate.SLACK), (-2.0, 0.3)):
        known = decontaminate.Items(items.item_id.tolist(), pa.array(items.text.str.lower()), space, cosine, slack)
        found.append({(lo + r, i) for lo, hi in words.row_ranges(offsets, 1 << 18) for r, i, *_ in known.leaks(decontaminate.Segments.of(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))})
    assert len(found[1]) > 30 and len(found[0] & found[1]) >= 0.9 * len(found[1])
    print("recall of candidates", len(found[0] & found[1]) / len(found[1]), "of", len(found[1]))


def test_quality_on_the_held_out_fold(spark):
    big = "/root/testdata/sf0.01"
    read = lambda t: spark.read.parquet(f"{big}/{t}.parquet")
    out = quality.classify(read("documents"), read("labels")).where("held_out").join(read("labels"), "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in out]) > 0.95


def test_factorisation_identity():
    m = quality.fit(pa.array(["a b c d. e f", "A!! B!! C!!", "x y z"]), np.array([1.0, 0.0, 1.0]), steps=2)
    data, offsets = words.utf8(pa.array(["a b q r. s"]))
    row, f, x = m.design(data, offsets)
    pairs = sum(float(m.v[f[i]] @ m.v[f[j]]) * x[i] * x[j] for i in range(len(f)) for j in range(i))
    assert abs(m.logits(row, f, x, 1)[0] - (m.w0 + (m.w[f] * x).sum() + pairs)) < 1e-4


def test_warc_chunks(spark):
    pages = spark.createDataFrame([(i, f"http://h.org/{i}", "é" * (i * 37) + "\r\n\r\nWARC/1.1") for i in range(30)], "page_id long, url string, html string")
    from quillstone.llm.storage import new_path

    path = new_path(spark, "warc-test")
    warc.write_archives(pages, path, chunk=64)
    assert spark.read.parquet(path).selectExpr("max(octet_length(data))").first()[0] < 700
    rows = {r.page_id: r for r in warc.read_archives(spark, path).collect()}
    assert all(rows[i].payload_bytes == len(("é" * (i * 37) + "\r\n\r\nWARC/1.1").encode()) for i in range(30))
    for archive in {r.archive for r in spark.read.parquet(path).select("archive").distinct().collect()}:
        stream = b"".join(warc.export_archive(spark, path, archive))
        while stream:
            head, _, rest = stream.partition(b"\r\n\r\n")
            n = int(re.search(rb"Content-Length: (\d+)", head)[1])
            assert head.startswith(b"WARC/1.1\r\n") and rest[n : n + 4] == b"\r\n\r\n"
            stream = rest[n + 4 :]


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((12, 16))
    rows = [(i, [float(x) for x in np.float32(centres[i % 12] + rng.standard_normal(16) * 0.12)], int(i % 3)) for i in range(700)]
    rows += [(1000 + i, rows[5][1], 2) for i in range(40)]
    out = {r.vec_id: r for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    x = np.array([r[1] for r in rows])
    n = np.linalg.norm(x, axis=1)
    near = (x @ x.T) / np.outer(n, n) >= 0.93
    same = np.array([r[2] for r in rows])
    near &= same[:, None] == same[None]
    want = near.sum(1) - 1
    got = np.array([out[r[0]].n_links for r in rows])
    assert (got <= want).all() and got.sum() >= 0.98 * want.sum()


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 8)
    rows = [(i, [1.0, 0.001 * (i % 50)], 0) for i in range(100)]
    out = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert {r.n_links for r in out} == {99} and {r.component_id for r in out} == {0}


def test_digits_of_other_scripts():
    assert not pii.plausible("x 1.1.1.² y", (2, 1, 9)) and not pii.plausible("x 1.1.1.٣ y", (2, 1, 9)) and pii.plausible("x 1.1.1.25 y", (2, 1, 10))


def test_items_without_words_take_no_room(spark, docs, monkeypatch):
    """Only items that hold a word count against the bound, and a benchmark beyond it is refused, not cut."""
    items = pq.read_table(f"{SF}/benchmark.parquet").to_pandas()
    leak = next((d, i) for d in docs.text for i in items.text if i.lower() in d.lower())
    frame = spark.createDataFrame([(1, leak[0]), (2, "nothing of it")], "doc_id long, text string")
    empty = [(i, x) for i, x in enumerate([None, "", "  ", "?!", "\n"] * 4)]
    monkeypatch.setattr(decontaminate, "MOST_QUERIES", 50)
    benchmark = spark.createDataFrame([*empty, (99, leak[1])], "item_id long, text string")
    space = decontaminate.fit_space(spark.createDataFrame(docs[["doc_id", "text"]]).withColumn("text", F.lower("text")))
    assert [(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame, benchmark, space).collect()] == [(1, 99)]
    with pytest.raises(ValueError, match="at most"):
        decontaminate.load_items(frame, spark.createDataFrame([(i, f"w{i}") for i in range(51)], "item_id long, text string"))


def plain_statistics(text):
    """The statistics of one text in the order of quality.STATS, byte by byte and word by word."""
    data, lines = text.encode(), text.encode().split(b"\n")
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", data) if w]
    low, n, size = [w.lower() for w in words], max(1, len(words)), max(1, len(data))
    kind = lambda b: 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 4 if b in b".,;:?" else 5 if b == 32 or 9 <= b <= 13 else 6 if b >= 128 else 0 if 97 <= b <= 122 else 3
    kinds, counts = collections.Counter(map(kind, data)), collections.Counter(low)
    runs = [tuple(low[i : i + 5]) for i in range(max(1, len(low) - 4))] if low else []
    ends = [len(line) + 1 for line in lines[:-1]] + [len(lines[-1])]
    return [
        *(kinds[k] / size for k in (1, 2, 3, 4, 5, 6)), sum(map(len, words)) / n, math.log1p(len(words)), len(counts) / math.sqrt(n), max(counts.values(), default=0) / n, len(set(runs)) / max(1, len(runs)),
        math.log1p(n / len(lines)), sum(x < 40 for x in ends) / len(lines), sum(kind(w[-1]) == 3 for w in words) / n, math.log1p(len(data)), sum(len(w) >= 7 for w in words) / n,
    ]


def test_quality_scores_one_text_at_a_time(spark, docs):
    """All texts of a table, scored by all pairs of their features, whatever rows they share a batch with."""
    texts = [*docs.text, "", "one", "two\n", "\n\n", "a\nb\n" + "c" * 50, "!? .. é"] * 2
    machine = quality.train(spark.createDataFrame(docs[["doc_id", "text"]]), spark.read.parquet(f"{SF}/labels.parquet"))
    want, n = {}, len(quality.STATS)
    for t in set(texts):
        stats = np.array(plain_statistics(t))
        counts = collections.Counter(words.word_hash(w.decode(), words.SPACE_WORDS) >> (64 - 15) for w in re.split(rb"[\x20\x09-\x0D]+", t.encode()) if w)
        value = {b: math.log1p(c) for b, c in counts.items()}
        norm = math.sqrt(sum(x * x for x in value.values())) or 1
        features = [(b, x / norm) for b, x in value.items()]
        for j in range(n):
            z = min(3, max(-3, (stats[j] - machine.mean[j]) / machine.scale[j]))
            features += [(quality.BUCKETS + j, z / math.sqrt(n)), (quality.BUCKETS + n + j * quality.BINS + int(sum(machine.edges[:, j] < stats[j])), 1 / math.sqrt(n))]
        at, x = np.array([f for f, _ in features]), np.array([v for _, v in features])
        vx = machine.v[at].astype(float) * x[:, None]
        want[t] = 1 / (1 + math.exp(-(machine.w0 + float(machine.w[at] @ x) + float(np.triu(vx @ vx.T, 1).sum()))))
    got = quality.score_column(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string").repartition(7), machine).collect()
    assert max(abs(r.score - want[r.text]) for r in got) < 2e-4
