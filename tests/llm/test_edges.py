"""Odd tables: very long texts, very many equal rows, repeated and null ids, and plain versions of what has none elsewhere."""

import html
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import brute
from tidewatch.llm import html_text, language_id, line_dedup, neighbours, packing, piece_nbest, quality_rules, suffix_dedup

SMALL = "/root/testdata/sf0.01"
TOKENIZER, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_article(page):
    """The article of a generated page: its headings and paragraphs, without markup."""
    inner = page.split("<article>", 1)[1].split("</article>", 1)[0]
    blocks = re.split(r"</?(?:p|h1)>", inner.replace("<br>", " "))
    return "\n\n".join(t for t in (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks) if t)


def test_pages_against_a_plain_extractor(spark):
    rows = spark.read.parquet(f"{SMALL}/pages.parquet")
    want = {r.page_id: plain_article(r.html) for r in rows.collect()}
    assert {r.page_id: r.text for r in html_text.html_text(rows).collect()} == want


def test_language_of_odd_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    long = docs.where("text is not null").orderBy(F.desc(F.length("text"))).first()
    text = long.text * (2_000_000 // len(long.text))
    odd = spark.createDataFrame([(None, long.text, None), (None, None, None), (long.doc_id, long.text, long.lang), (10**9, text, None), (10**9, text, None), (10**9 + 1, "12 34 ...", None)], docs.schema)
    got = language_id.language_id(docs.unionByName(odd)).collect()
    assert len(got) == docs.count() + 6
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len({tuple(r) for r in by[10**9]}) == 1 and by[10**9][0].lang_pred == long.lang and by[10**9 + 1][0].lang_pred == "und"
    assert sorted((r.lang_pred, r.held_out) for r in by[None])[-1][0] == "und" and len({r.lang_pred for r in by[long.doc_id]}) == 1


def test_pieces_of_a_very_long_text(spark):
    texts = ["x" * 300_000, "ab cd " * 40_000, "é" * 100_000]
    got = piece_nbest.round_trip(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PIECES).collect()
    told = [c for c in got[0].asDict() if isinstance(got[0][c], bool)]
    assert len(got) == 3 and told and all(r[c] for r in got for c in told)


def test_vectors_of_other_lengths_and_repeated_ids(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.standard_normal(6)]) for i in range(200)]
    odd = [(i, [float(x) for x in rng.standard_normal(2 + i % 2)]) for i in range(1000, 1100)] + [(50, rows[3][1]), (7, rows[7][1]), (3000, [1.0] * 9)]
    got = neighbours.nearest(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")).collect()
    # of two rows of one id the first in sort order counts
    vectors = dict(sorted(rows + odd, key=lambda r: r[1], reverse=True))
    for q in (0, 50, 100, 150, 1000, 1050):
        own = [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)]
        same = [(i, v) for i, v in vectors.items() if i != q and len(v) == len(vectors[q])]
        scores = {i: float(np.dot(v, vectors[q]) / np.linalg.norm(v) / np.linalg.norm(vectors[q])) for i, v in same}
        want = sorted(scores, key=lambda i: (-round(scores[i], 12), i))[:5]
        assert [i for i, _ in own] == want and np.allclose([s for _, s in own], [scores[i] for i in want])
    # no other vector has its length
    assert {r.query_id for r in got} == {0, 50, 100, 150, 1000, 1050}


def test_parallel_vectors_are_ties(spark):
    v = np.random.default_rng(2).standard_normal(24)
    rows = [(i, [float(x) for x in v * f]) for i, f in enumerate((1, 3, 0.1, 7, 1 / 3, 1e-3, 11, 5))]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 0] == [1, 2, 3, 4, 5]


def test_very_many_equal_rows(spark):
    text = "the same first line of them all\nand a second line that is not short\n" + " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(i, text) for i in range(4000)], "doc_id long, text string").repartition(7)
    lines = {r.doc_id: (r.n_removed, r.n_chars) for r in line_dedup.line_digest(docs).collect()}
    assert lines == {i: (3, 0) if i else (0, len(text)) for i in range(4000)}
    cut = {r.doc_id: r.n_removed for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert cut == {i: len(text) if i else 0 for i in range(4000)}
    pieces = packing.packing(docs, TOKENIZER).collect()
    n = len(Tokenizer.from_file(TOKENIZER).encode(text, add_special_tokens=False).ids) + 1
    assert sum(r.length for r in pieces) == 4000 * n and {r.doc_tokens for r in pieces} == {n}


def test_pack_order_follows_the_curve(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    library = Tokenizer.from_file(TOKENIZER)
    keys = {}
    for r in docs.collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], np.uint32)
        keys[r.doc_id] = int(packing.curve_keys(ids, np.array([0, len(ids)]))[0])
    pieces = sorted(packing.packing(docs, TOKENIZER).collect(), key=lambda r: (r.sequence_id, r.offset))
    order = [(keys[r.doc_id], r.doc_id) for r in pieces if r.start == 0]
    assert len(order) == len(keys) and order == sorted(order)
    sizes = {}
    for r in pieces:
        sizes[r.sequence_id] = sizes.get(r.sequence_id, 0) + r.length
    # what isn't full is a power of two, and padded nowhere
    assert all(n == 2048 or n & (n - 1) == 0 for n in sizes.values())


def test_learned_rules_cover_what_they_say(spark):
    """Each rule, in its place, covers enough of what is left and is right often enough; the verdict is the list read from the top."""
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    rules = quality_rules.learned(docs, labels)
    rows = [r.asDict() for r in quality_rules.labelled(docs, labels).collect()]
    held = lambda r, terms: all(r[f] > at if sign == ">" else r[f] <= at for f, sign, at in terms)
    left = rows
    assert rules
    for terms in rules:
        covered = [r for r in left if held(r, terms)]
        bad = sum(r["bad"] for r in covered)
        assert len(covered) >= quality_rules.MIN_COVER and bad >= quality_rules.MIN_PRECISION * len(covered)
        left = [r for r in left if not held(r, terms)]
    kept = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs, labels).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        n, *_, rep = brute.quality(texts[r["doc_id"]])
        assert kept[r["doc_id"]] == (not (n < 50 or 100 * rep > 50 * n) and not any(held(r, terms) for terms in rules))


@pytest.mark.parametrize("size", [0, 1])
def test_tables_of_no_and_one_row(spark, size):
    docs = spark.createDataFrame([(1, "one text of a few words here")][:size], "doc_id long, text string")
    assert line_dedup.line_dedup(docs).count() == suffix_dedup.suffix_dedup(docs).count() == size
    assert packing.packing(docs, TOKENIZER).agg(F.count("*")).first()[0] >= size
