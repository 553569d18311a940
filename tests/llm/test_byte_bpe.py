"""Byte-level BPE against the library that its vocabulary file is made for."""

import base64
import hashlib
import random
import sys

import public_tokenizers
import pytest
import tiktoken

from tidewatch.llm import byte_bpe, pretokens, queries

PATH, PATTERN, SMALL = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, "/root/testdata/sf0.01"


def odd_texts():
    rng = random.Random(7)
    char = lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x800), rng.randrange(0x800, 0xD800), rng.randrange(0xE000, 0x110000), 32, 32, 10]))
    plain = ["", " ", "a  b   c\n\n d ", "don'table can'tx 's 'S I'll", "日本語 テキスト", "\U00010940\U000107bb 12\U0001246f", "é" * 5000, " " * 1000 + "x", "\r\n\t x", "<|endoftext|>", "\x1c a\x85b​᠎", "x" * 300_000, "\0﻿"]
    return plain + ["".join(char() for _ in range(150)) for _ in range(100)]


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def digest(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_query_on_all_documents(spark, library):
    want = {r.doc_id: digest(library, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert {r.doc_id: tuple(r)[1:] for r in queries.queries()["op12_byte_bpe"](spark, SMALL).collect()} == want


def test_odd_texts_and_round_trip(spark, library):
    rows = [*enumerate(odd_texts()), (None, "null id"), (7, None), (7, "twice"), (7, "twice")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, ids string, bytes int")
    key = lambda x: (x[0] is not None, x)
    assert sorted((tuple(r) for r in byte_bpe.byte_bpe_digest(docs, PATH, PATTERN).collect()), key=key) == sorted(((i, *digest(library, t)) for i, t in rows), key=key)
    ids = byte_bpe.encoded(docs, PATH, PATTERN)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids) for r in ids.collect()) == sorted((i is not None, i or 0, library.encode_ordinary(t or "")) for i, t in rows)
    assert sorted(bytes(r.bytes) for r in byte_bpe.decoded(ids, PATH, PATTERN).collect()) == sorted((t or "").encode() for _, t in rows)
    assert byte_bpe.byte_bpe_digest(docs.limit(0), PATH, PATTERN).count() == 0


def test_long_texts_in_parts_and_a_short_memory(library, monkeypatch):
    texts = odd_texts() + ["one  two\n three four " * 300]
    bpe = byte_bpe.ByteBPE(PATH, PATTERN)
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 50)
    monkeypatch.setattr(byte_bpe, "FIRST", 10)
    for text in texts:
        cut = list(pretokens.parts(text, 40))
        assert "".join(cut) == text and max(map(len, cut)) <= max(len(text), 1)
        got = [i for part in cut for i in bpe.ids[bpe.encode([part])[0]].tolist()]
        assert got == library.encode_ordinary(text)


def test_token_that_merges_do_not_reach(tmp_path):
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"xyz": 259}
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in ranks.items()))
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    bpe = byte_bpe.ByteBPE(str(path), PATTERN)
    for text in ("xyz", "xyzxyz abc bcab", "aab"):
        assert bpe.ids[bpe.encode([text])[0]].tolist() == library.encode_ordinary(text)


def test_classes_of_characters():
    every = "".join(chr(c) for c in [*range(0xD800), *range(0xE000, sys.maxunicode + 1)])
    for matches in (pretokens.tiktoken_matches, pretokens.tokenizers_matches):
        assert set(matches(r"\s")) == {c for c in every if c.isspace() and c not in "\x1c\x1d\x1e\x1f"}
        assert set("aZéж日") < set(matches(r"\p{L}")) and set("19²Ⅷ") < set(matches(r"\p{N}"))
