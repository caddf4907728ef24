"""Byte-level BPE against the tiktoken library, and against merges done one by one in plain Python."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
from pyspark.sql import functions as F

from quillstone.llm import byte_bpe
from quillstone.llm import queries as llm

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder(ranks):
    return byte_bpe.Coder(byte_bpe.Vocabulary(ranks))


def rows(coder, texts):
    ids, ends = coder.encode(pa.array(texts, pa.string()))
    bounds = [0, *ends.tolist()]
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], coder.decode(ids, ends)


def test_made_up_texts(coder, library):
    draw = random.Random(1)
    parts = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", "a", "B", "é", "1", "²", "!", "中", "文", "́", "😀", "\x00", "\x1c", "\x85", "’", "0", "the", "​", "　"]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 40))) for _ in range(4000)]
    texts += [None, "", "a" * 50_000, "ab" * 3000, " " * 3000 + "x", "\n" * 777, "é" * 500, "".join(draw.choices("abcdefghij", k=700)), "<|endoftext|>"]
    ids, decoded = rows(coder, texts)
    for text, got, raw in zip(texts, ids, decoded, strict=True):
        assert got == library.encode_ordinary(text or "") and raw == (text or "").encode()


def test_characters_of_all_kinds(coder, library):
    texts = ["the{0}the 1{0}1!!{0}!! {0}".format(chr(c)) for c in range(0, 0x110000, 23) if not 0xD800 <= c < 0xE000]
    ids, _ = rows(coder, texts)
    assert ids == [library.encode_ordinary(t) for t in texts]


def test_any_merge_table():
    """Ranks in no order of training: the long query may contract repeats together only where that comes to the same."""
    draw = random.Random(2)
    ranks = {bytes([b]): b for b in range(256)}
    for length in (2, 3, 4, 5):
        for _ in range(40):
            ranks.setdefault("".join(draw.choices("abc", k=length)).encode(), len(ranks))
    order = draw.sample(range(256, len(ranks)), len(ranks) - 256)
    ranks = {t: r if r < 256 else order[r - 256] for t, r in ranks.items()}

    def one_by_one(piece):
        tokens = [piece[i : i + 1] for i in range(len(piece))]
        while pairs := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(tokens, tokens[1:], strict=False)) if a + b in ranks]:
            i = min(pairs)[1]
            tokens[i : i + 2] = [tokens[i] + tokens[i + 1]]
        return [ranks[t] for t in tokens]

    texts = ["".join(draw.choices("abc", k=n)) for n in [*range(6, 40)] * 3 + [60, 200, 300, 301]] + ["a" * 90, "ab" * 70]
    ids, decoded = rows(byte_bpe.Coder(byte_bpe.Vocabulary(ranks)), texts)
    assert ids == [one_by_one(t.encode()) for t in texts] and decoded == [t.encode() for t in texts]


def test_little_memory_changes_nothing(coder, ranks, library, monkeypatch):
    for name, value in (("PIECE_BYTES", 1000), ("SPAN", 7), ("KNOWN", 50), ("STEP_ROWS", 100)):
        monkeypatch.setattr(byte_bpe, name, value)
    texts = pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist()[:8] + ["x y" * 400, "q" * 200]
    ids, decoded = rows(byte_bpe.Coder(byte_bpe.Vocabulary(ranks)), texts)
    assert ids == [library.encode_ordinary(t) for t in texts] and decoded == [t.encode() for t in texts]


def test_the_query(spark, library):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    want = []
    for d in docs:
        ids = library.encode_ordinary(d["text"] or "")
        want.append((d["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((d["text"] or "").encode()).hexdigest()))
    assert sorted(map(tuple, llm.op11_byte_bpe(spark, SF).collect())) == sorted(want)


def test_edges(spark, library):
    docs = spark.createDataFrame([(1, "one two"), (1, "one two"), (2, None), (None, ""), (3, "word " * 30_000)], "doc_id long, text string").withColumn("ids", F.lit(5))
    coded = byte_bpe.encode(docs, PATH)
    assert coded.columns == ["doc_id", "text", "ids", "_ids"]
    back = byte_bpe.decode(coded, PATH, "_ids")
    for r in back.collect():
        assert r._ids == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode() and r.ids == 5
    assert byte_bpe.round_trip(docs.limit(0), PATH).count() == 0
    none = hashlib.sha256(b"").hexdigest()
    assert sorted(r[1:] for r in byte_bpe.round_trip(docs.where("text is null or text = ''"), PATH).collect()) == [(0, none, none)] * 2
    empty = byte_bpe.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>"), PATH).collect()
    assert [bytes(r.decoded) for r in empty] == [b"", b""]
    with pytest.raises(Exception, match="without a token"):
        byte_bpe.decode(spark.createDataFrame([([60_000],)], "ids array<int>"), PATH).collect()
    with pytest.raises(ValueError, match="no token"):
        byte_bpe.Vocabulary({b"a": 0})
