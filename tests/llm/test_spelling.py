"""Spelling variants against plain neighbourhoods of deletions."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tidewatch.llm import queries, spelling_variants as S

SMALL = "/root/testdata/sf0.01"


def plain_words(rows):
    out = Counter()
    for i, t in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            low = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            if h % 31 == 0:
                at = h % len(low)
                low = low[:at] + low[at + 1 :]
            out[low] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def plain_near(words):
    """Words are near if one is among the other's deletions, or the same deletion of the same place gives both."""
    near, holes = defaultdict(set), defaultdict(set)
    for w in words:
        for k in range(len(w)):
            short = w[:k] + w[k + 1 :]
            if short in words:
                near[w].add(short)
                near[short].add(w)
            holes[k, short].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    return near


def plain(rows):
    words = plain_words(rows)
    near, form = plain_near(words), {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return out


def read(df):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_on_all_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = plain(rows)
    assert any(f for _, f, *_ in want)
    assert read(queries.queries()["op13_spelling_variants"](spark, SMALL)) == want


@pytest.mark.parametrize("most", [2_000, 3])
def test_odd_tables(spark, monkeypatch, most):
    """Chains of forms, ties, long words, letters at both ends; with a small limit blocks are halved down to one letter."""
    monkeypatch.setattr(S, "MOST", most)
    rng = random.Random(3)
    many = ["shared" + "".join(rng.choice("abcé") for _ in range(rng.randint(1, 4))) for _ in range(300)] + ["".join(rng.choice("ab") for _ in range(8)) for _ in range(200)]
    long = "lang" * 600
    chain = ["chainworda"] * 2000 + ["chainwordb"] * 200 + ["chainwordbc"] * 20 + ["chainwrdbc"] * 2
    rows = [
        (1, " ".join(chain)), (None, "Resumées resumées Résumées résumées resumees"), (2, None), (3, ""), (4, "short words only"), (5, " ".join(many)), (6, " ".join(many)), (7, f"{long} {long}x"), (8, f"{long} {long}x y{long} y{long}"),
        (9, "tiewords " * 20 + "tiewordz " * 20 + "tieword_ tiewordx tiewordx xtieword xtieword"), (9, "repeated repeated Repeated"), (9, "repeated repeated Repeated"), (10, "×××××××× ÷÷÷÷÷÷÷÷ ×××××××× ÷÷÷÷÷÷÷÷ ŸŸŸŸŸŸŸŸ"),
    ]
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, word string, n int, form string")
    got = read(S.spelling_variants(docs))
    assert got == plain(rows)
    assert {r[:3] for r in got if r[0].startswith("chain")} >= {("chainwordbc", "chainwordb", "chainworda"), ("chainwrdbc", "chainwordbc", "chainworda")}
    assert S.spelling_variants(docs.limit(0)).count() == 0


def test_very_long_words(spark):
    long = "lang" * 50_000
    words = [long, f"{long}x", f"{long[:99_999]}y{long[100_000:]}", f"{long}xy"]
    rows = [(i, " ".join(words)) for i in range(200) if all(zlib.crc32(f"{i}:{w}".encode()) % 31 for w in words)][:2]
    got = {r.word: (r.n, r.n_near) for r in S.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(zip(words, [(2, 2), (2, 2), (2, 1), (2, 1)], strict=True))
