"""Token alignment against a plain version on whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidewatch.llm import queries, token_alignment as T

SMALL = "/root/testdata/sf0.01"
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN


class Plain:
    def __init__(self):
        self.a, self.b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
        self.a.encode_special_tokens = True
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}
        self.raw_a = {i: bytes(byte[c] for c in t) for t, i in self.a.get_vocab().items() if all(c in byte for c in t)}
        self.raw_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]

    def tokens(self, text):
        whole = (" " + text).encode() if text else b""
        a, b = (self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)) if text else ([], [])
        ranges = []
        for ids, raw in ((a, self.raw_a), (b, self.raw_b)):
            if b"".join(raw[i] for i in ids) != whole:
                return [], []
            at, own = 0, []
            for i in ids:
                own.append((i, at, at + len(raw[i])))
                at += len(raw[i])
            ranges.append(own)
        return ranges

    def all(self, rows):
        told, counts = [], Counter()
        for i, text in rows:
            a, b = self.tokens(text)
            cuts = sorted({e for *_, e in a} & {e for *_, e in b})
            groups, links, lo = [], [], 0
            j = 0
            for cut in cuts:
                groups.append(([t for t, _, e in a if lo < e <= cut], [t for t, _, e in b if lo < e <= cut]) if len(a) < 3000 else None)
                lo = cut
            for t, s, e in a:
                while j and b[j - 1][2] > s:
                    j -= 1
                while j < len(b) and b[j][2] <= s:
                    j += 1
                while j < len(b) and b[j][1] < e:
                    links.append((t, b[j][0]))
                    j += 1
            counts.update(links)
            if None in groups:
                groups, x, y = [], 0, 0
                for cut in cuts:
                    m, n = x, y
                    while x < len(a) and a[x][2] <= cut:
                        x += 1
                    while y < len(b) and b[y][2] <= cut:
                        y += 1
                    groups.append(([t for t, *_ in a[m:x]], [t for t, *_ in b[n:y]]))
            told.append((i, a, b, groups, links))
        most = defaultdict(int)
        for (_, b), n in counts.items():
            most[b] = max(most[b], n)
        out = []
        for i, a, b, groups, links in told:
            text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
            out.append((i, len(a), len(b), len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
        return out, counts, {i: groups for i, _, _, groups, _ in told}


@pytest.fixture(scope="module")
def plain():
    return Plain()


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
key = lambda x: (x[0] is not None, x)


def test_query_on_all_documents(spark, plain):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want, _, _ = plain.all(rows)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in queries.queries()["op11_token_alignment"](spark, SMALL).collect()) == sorted(want)


def odd_texts():
    rng = random.Random(5)
    char = lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x800), rng.randrange(0x800, 0xD800), rng.randrange(0xE000, 0x110000), 32, 32, 10, 13, 0x2581 if rng.random() < 0.02 else 97]))
    fixed = [
        None, "", " ", "   ", "\n", "a  b   c\n\n d ", " leading", "trailing  ", "don'table can'tx they'll've", "日本語 テキスト", "\U00010940\U000107bb 12\U0001246f", "a▁b", "▁", "<|endoftext|> and <s> </s> <unk> <0x0A>",
        "x;\r\ny);\r\n{\r", "m².", "²." * 30, "𓀀𓀁 ᚠᚢ", "é" * 500, "x" * 20_000, "\0 \x01", "\x1c a\x85b​᠎", "naïve café 😀😀 👩‍👩‍👧",
    ]
    return fixed + ["".join(char() for _ in range(120)) for _ in range(150)]


@pytest.mark.parametrize("size", [8_000_000, 2_000])
def test_odd_texts(spark, plain, monkeypatch, size):
    """Also in many small blocks."""
    monkeypatch.setattr(T, "BLOCK_BYTES", size)
    rows = [*enumerate(odd_texts()), (None, "a null id"), (3, "twice here"), (3, "twice here"), (999, "the end of the text. " * 2000)]
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, block string, n int, pairs string").repartition(3)
    want, counts, groups = plain.all(rows)
    assert sorted((tuple(r) for r in T.token_alignment(docs, *PATHS).select(*COLUMNS).collect()), key=key) == sorted(want, key=key)
    assert {(r.a, r.b): r.n for r in T.pair_counts(docs, *PATHS).collect()} == dict(counts)
    got = {r.doc_id: [(list(g.a), list(g.b)) for g in r.groups] for r in T.alignments(docs, *PATHS).collect()}
    assert got == groups


def test_few_bytes_at_a_time(spark, plain, monkeypatch):
    """Whatever a task's input, what is read or written of blocks at once stays small: one of them, of some MB."""
    rng, files, write = random.Random(7), [], T.materialize

    def noted(df, name, *more):
        out = write(df, name, *more)
        files.extend(out.inputFiles() if name == "blocks" else [])
        return out

    monkeypatch.setattr(T, "materialize", noted)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(500)]
    text = " ".join(rng.choices(words, k=170_000))
    docs = spark.createDataFrame([(i, text) for i in range(12)], "doc_id long, text string").coalesce(1)
    got = sorted(tuple(r) for r in T.token_alignment(docs, *PATHS).select(*COLUMNS).collect())
    # twelve equal texts: each pair counts twelve times as often
    (one,), _, _ = plain.all([(0, text)])
    assert got == [(i, *one[1:6], 12 * one[6], one[7]) for i in range(12)]
    assert len(files) == 1
    told = pq.ParquetFile(files[0].removeprefix("file://")).metadata
    groups = [told.row_group(k) for k in range(told.num_row_groups)]
    assert len(groups) >= 4 and all(g.num_rows == 1 and g.total_byte_size < 4_000_000 for g in groups)


def test_no_rows(spark):
    assert T.token_alignment(spark.createDataFrame([], "doc_id long, text string"), *PATHS).count() == 0


def test_short_memory(plain, monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 15)
    monkeypatch.setattr(T, "FIRST", 5)
    own = T.Aligner(*PATHS)
    for text in odd_texts():
        own.forget()
        units, at = own.units([text or ""])
        assert "".join(units) == (" " + text if text else "") and at.tolist() == [0, len(units)]
        rows = own.numbers(units)
        a, b = plain.tokens(text)
        assert (own.table(rows)[:, 0].all() and len(units) > 0) == bool(a)
        if a:
            assert own.table(rows)[:, :2].sum(axis=0).tolist() == [len(a), len(b)]
