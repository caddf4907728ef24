"""Ranked lexical search against scores of all documents, one by one."""

import collections
import math
import re

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillstone.llm import lexical
from quillstone.llm import queries as llm

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    held = [(i, collections.Counter(t)) for i, text in docs if (t := terms(text))]
    many, every = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(w for _, c in held for w in c)
    out = []
    for item, text in items:
        scores = []
        for doc, counts in held:
            m = 25 + (75 * sum(counts.values()) * many) // every
            score = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * counts[w]) // (1000 * counts[w] + 8 * m)) for w in terms(text) if w in counts)
            if score > 0:
                scores.append((score, doc))
        scores.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        out += [(item, r, doc, score) for r, (score, doc) in enumerate(scores[:k], 1)]
    return out


def order(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(3)
    words = [f"w{int(x)}" for x in rng.zipf(1.3, 20_000) % 3000]
    docs, at = [], 0
    for i in range(700):
        n = int(rng.integers(1, 60))
        docs.append((i, " ".join(words[at % 19_000 : at % 19_000 + n])))
        at += 37
    docs += [(i, docs[5][1]) for i in range(700, 900)]  # a large group of copies: ties
    items = [(i, " ".join(rng.choice(words, int(rng.integers(1, 12))))) for i in range(40)] + [(40, docs[5][1]), (41, docs[5][1]), (42, "nothing like it")]
    return docs, items


@pytest.mark.parametrize("shard", [(4096, 4 << 20), (64, 900), (1, 10)])
def test_all_scores(spark, corpus, monkeypatch, shard):
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard[0])
    monkeypatch.setattr(lexical, "SHARD_BYTES", shard[1])
    docs, items = corpus
    # tests run in one process: the tasks' workers see the parameters by the function that is shipped
    found = lexical.rank(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"))
    assert order(found.collect()) == order(brute(docs, items))


def test_shards_of_any_size(corpus):
    """The tree alone, over shards cut anyhow, in this process."""
    docs, items = corpus
    texts = sorted({t for _, t in items})
    queries = lexical.Queries(texts)
    held = [collections.Counter(terms(t)) for _, t in docs]
    words = [t for _, t in docs]
    own = {int(h): w for text in texts for h, w in zip(lexical.hash_words(*lexical.utf8(lexical.pa.array([text])))[0], terms(text), strict=True)}
    df = np.array([sum(own[int(t)] in c for c in held) for t in queries.terms])
    queries.weigh(len(docs), sum(sum(c.values()) for c in held), df)
    want = {(i, r): (d, s) for i, r, d, s in brute(docs, list(enumerate(texts)))}
    for cut in (1, 2, 16, 17, 300, 5000):
        found = collections.defaultdict(list)
        opened = 0
        for lo in range(0, len(docs), cut):
            batch = lexical.pa.RecordBatch.from_arrays([lexical.pa.array([d for d, _ in docs[lo : lo + cut]]), lexical.pa.array(words[lo : lo + cut])], ["doc_id", "text"])
            for row in lexical._rows(lexical.shards_of([batch], 0, cut, 1 << 30)):
                tree = lexical.Tree(row, queries)
                for q, bound in enumerate(tree.bounds(queries).tolist()):
                    exact = {d: s for (i, _), (d, s) in want.items() if i == q}
                    assert all(s <= bound for d, s in exact.items() if docs[lo][0] <= d <= docs[min(lo + cut, len(docs)) - 1][0])
                    if bound:
                        found[q] += tree.best(queries, q, bound, 1, 10)
                        opened += 1
        got = {(q, r): (d, s) for q, f in found.items() for r, (s, d) in enumerate(lexical._best(f, 10), 1)}
        assert got == want and opened


def test_the_query_and_its_sql(spark):
    docs, items = (pq.read_table(f"{SF}/{t}.parquet").to_pylist() for t in ("documents", "benchmark"))
    got = order(llm.op13_lexical(spark, SF).collect())
    assert got == order(brute([(d["doc_id"], d["text"]) for d in docs], [(i["item_id"], i["text"]) for i in items]))
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert got == order(db.execute(lexical.ORACLE).fetchall())


def test_blocks_of_queries(spark, corpus, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 300)
    docs, items = corpus
    docs, items = docs[:200], items[:12]
    found = lexical.rank(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 3)
    assert order(found.collect()) == order(brute(docs, items, 3))


def test_edges(spark):
    docs = [(1, "Ash Birch ash"), (1, "Ash Birch ash"), (2, None), (3, ""), (4, "... --"), (None, "birch"), (None, "ash birch ash"), (5, "É é ÉA a_b"), (6, "oak " * 50_000), (7, "x\x00y 1²")]
    items = [(1, "ash"), (1, "ash"), (2, None), (3, ""), (4, "?!"), (None, "BIRCH birch"), (5, "éa É"), (6, "oak x y ²")]
    docs_, items_ = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank", F.lit(1)), spark.createDataFrame(items, "item_id long, text string").withColumn("query", F.lit("q"))
    assert order(lexical.rank(docs_, items_).collect()) == order(brute(docs, items))
    assert lexical.rank(docs_.limit(0), items_).count() == 0 and lexical.rank(docs_, items_.limit(0)).count() == 0 and lexical.rank(docs_.where("doc_id = 2"), items_).count() == 0
    out = lexical.rank(docs_, items_)
    assert [f.dataType.simpleString() for f in out.schema] == ["bigint", "int", "bigint", "bigint"]
