"""The operators against plain versions, on small tables with nulls, blanks, ties, repeats and clashing names."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import brute
from tidewatch.llm import html_text, jaccard_join, language_id, line_dedup, neighbours, packing, piece_nbest, quality_rules, suffix_dedup, token_files
from tidewatch.llm.components import components

SMALL = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, class string, first string, row string, own string, n int, list string, removed string, ranges string, n_lines string"
TOKENIZER, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def prose(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abdeilnorstu") for _ in range(rng.randint(2, 8))) for _ in range(n)]
    return " ".join(w + ("\n" if k % 17 == 16 else "") for k, w in enumerate(words))


def table_rows():
    a = prose(1, 160)
    changed = a.split(" ")
    changed[40], changed[90] = "changed", "other"
    return [
        (1, a), (2, " ".join(changed)), (3, a), (4, prose(2, 200)), (5, None), (6, ""), (7, " \n \t"), (8, "one two"), (9, "One TWO"), (10, "word " * 9000 + prose(3, 30)),
        (11, prose(4, 80) + "\n" + a[100:420] + "\n" + prose(5, 60)), (12, "é ü ñ çà " * 40), (13, "x" * 350), (14, prose(6, 3)), (15, a.upper()), (16, "# $ % | <b> & *"), (17, "1234 5678"),
        (18, prose(4, 80).replace("a", "e", 3)), (19, "日本語のテキスト。" * 30),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), "c", "f", "r", "o", 1, "l", "x", "y", "z") for i, t in table_rows()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids besides the plain rows."""
    rows = [(i, t, None, None, None, None, None, None, None, None, None, None, None, None) for i, t in [*table_rows()[:6], (None, table_rows()[0][1]), (None, None), (4, table_rows()[3][1]), (4, table_rows()[3][1])]]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality_counts(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (2, 1), (4, 1), (16, 0), (16, 1), (None, 0), (13, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels).collect()}
    for i, t in table_rows():
        n, chars, symbols, dup, rep = brute.quality(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep), i
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n)
        assert not (r.kept and r.base_failed)
    assert quality_rules.quality_rules(none, labels.limit(0)).count() == 0


def test_quality_learns(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = quality_rules.quality_rules(docs, labels).join(labels, "doc_id").where("not base_failed").collect()
    good = [r for r in rows if r.quality == 1]
    assert sum(r.kept for r in good) >= 0.98 * len(good)
    assert sum(not r.kept for r in rows if r.quality == 0) >= 0.9 * sum(r.quality == 0 for r in rows)
    kept = quality_rules.accepted(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (9, 8), (8, 7), (7, 1), (11, 11), (20, 30), (None, 3)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 4: 4, 5: 4, 20: 20, 30: 20}


def test_components_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr("tidewatch.llm.components.TASK_EDGES", 7)
    rng, tied = random.Random(3), brute.Sets()
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    for a, b in edges:
        tied.union(a, b)
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {x: tied.find(x) for e in edges for x in e if e[0] != e[1]} | {x: tied.find(x) for x in got}


def test_jaccard(docs, odd, none):
    want = brute.near_components(table_rows())
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == want
    rows = jaccard_join.jaccard_components(odd).collect()
    assert len(rows) == 10
    assert {r.component_id for r in rows if r.doc_id in (1, 2, 3) or r.doc_id is None and r.n_shingles} == {1}
    assert jaccard_join.jaccard_components(none).count() == 0
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in want.items() if c == i}


def test_jaccard_family(spark, monkeypatch):
    """A family of copies, each edited elsewhere, in small blocks and with frequent shingles."""
    monkeypatch.setattr(jaccard_join, "LIST_BLOCK", 5)
    monkeypatch.setattr(jaccard_join, "HOT_AT", 3)
    monkeypatch.setattr(jaccard_join, "HOT_LOCAL", 2)
    rng, base, rows = random.Random(8), prose(20, 120).split(" "), []
    for i in range(40):
        own = list(base)
        for k in rng.sample(range(120), rng.choice([1, 3, 5])):
            own[k] = f"w{i}x{k}"
        rows.append((i, " ".join(own)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    assert got == brute.near_components(rows)


def test_suffix_order():
    rng = random.Random(1)
    for k in (1, 2, 3, 26):
        for _ in range(120):
            s = [rng.randrange(k) for _ in range(rng.randint(0, 40))]
            s = s * rng.choice([1, 1, 3])
            assert suffix_dedup.suffix_order(s) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("cap", [suffix_dedup.CAP, 2])
def test_suffix_dedup(docs, odd, none, monkeypatch, cap):
    monkeypatch.setattr(suffix_dedup, "CAP", cap)
    flags = brute.covered(table_rows())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert got == {i: brute.cut_row(t, flags[i]) for i, t in table_rows()}
    cut = suffix_dedup.cut_repeats(docs)
    assert cut.columns == docs.columns
    assert {r.doc_id: r.text for r in cut.collect()} == {i: brute.cut_text(t, flags[i]) if t else t for i, t in table_rows()}
    if cap > 2:
        rows = suffix_dedup.suffix_dedup(odd).collect()
        assert len(rows) == 10 and all(r.n_removed == r.n_bytes for r in rows if r.doc_id is None)
        assert suffix_dedup.suffix_dedup(none).count() == 0


def test_suffix_dedup_of_periodic_hot_and_repeated_text(spark, monkeypatch):
    """Short periods, a passage in hundreds of other surroundings, rows that occur again in other partitions, text in stretches."""
    monkeypatch.setattr(suffix_dedup, "CAP", 20)
    monkeypatch.setattr(suffix_dedup, "STRETCH", 900)
    rng = random.Random(3)
    some = lambda n: "".join(rng.choice("ab ") for _ in range(n))
    core = "".join(rng.choice("abcdefgh") for _ in range(130))
    rows = [(i, some(60) + core + some(60)) for i in range(300)] + [(1000 + i, "x" * 3000 + "ab" * 700 + "word " * 400) for i in range(2)]
    rows += [(2000 + i, core[3:]) for i in range(100)] + [(3000, "x" * 200_000)]
    flags = brute.covered(rows)
    df = spark.createDataFrame(rows + rows[:50] + rows[-5:], "doc_id long, text string").repartition(5)
    got = [tuple(r) for r in suffix_dedup.suffix_dedup(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert len(got) == len(rows) + 55 and set(got) == {(i, *brute.cut_row(t, flags[i])) for i, t in rows}


def test_long_periodic_text_brings_one_context():
    from types import SimpleNamespace

    import pyarrow as pa

    class Plain:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            return run

    full, empty = SimpleNamespace(value=np.full(1024, -1, np.int64)), SimpleNamespace(value=np.zeros(1024, np.int64))
    batch = pa.RecordBatch.from_pydict({"first": [1], "class": [5], "text": ["x" * 2_000_000]})
    found = list(suffix_dedup._contexts(Plain(), 8, full, empty)(iter([batch])))
    assert sum(b.nbytes for b in found) < 10_000
    assert sum(b.nbytes for b in suffix_dedup._anchor_rows(Plain(), 8)(iter([batch]))) < 100_000


def test_line_dedup(docs, odd, none):
    out = line_dedup.line_dedup(docs)
    assert [c for c in out.columns if c != "n_removed"] == [*[c for c in docs.columns if c != "n_lines"], "n_lines"]
    assert {r.doc_id: r.text for r in out.collect()} == brute.dedup_lines(table_rows())
    rows = line_dedup.line_digest(odd).collect()
    assert len(rows) == 10 and len({tuple(r) for r in rows if r.doc_id == 4}) == 1
    assert line_dedup.line_digest(none).count() == 0


def plain_ids():
    t = Tokenizer.from_file(TOKENIZER)
    return {i: t.encode(x or "", add_special_tokens=False).ids for i, x in table_rows()}


def test_tokens_are_the_library_s():
    """Strings of added tokens, in their own case, alone, repeated and glued to letters, in any document of a slice."""
    from tidewatch.llm.tokens import encoder

    library = Tokenizer.from_file(TOKENIZER)
    rng = random.Random(9)
    parts = ["a", " ", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", "word.", "\n", "0", "7 0", "É", "e\u0301", "\u0301", "don't", "", "日本", "|>"]
    texts = ["", "<|endoftext|>", "a <|endoftext|> b", "x<|startoftext|><|endoftext|>y", "<|endof"] + ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(3000)] + ["text|> end"]
    raw = [t.encode() for t in texts]
    ids, offsets = encoder(TOKENIZER).encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_elias_fano():
    rng = random.Random(5)
    for n in (1, 2, 70, 500):
        values = np.array(sorted(rng.randrange(9 * n) for _ in range(n)))
        again = token_files.EliasFano.from_bytes(token_files.EliasFano.of(values).to_bytes())
        assert again.values().tolist() == values.tolist() == [again[i] for i in range(n)]


def test_token_files(docs, odd, none):
    at, ids = 0, plain_ids()
    for r in token_files.token_files(docs, TOKENIZER).orderBy("doc_id").collect():
        own = [*ids[r.doc_id], 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(own), brute.crc(own))
        at += len(own)
    assert token_files.token_files(odd, TOKENIZER).count() == 10
    assert token_files.token_files(none, TOKENIZER).count() == 0


def test_packing(docs, odd, none):
    ids, pieces, sequences = plain_ids(), defaultdict(list), defaultdict(list)
    for r in packing.packing(docs, TOKENIZER).collect():
        own = [*ids[r.doc_id], 1]
        assert r.doc_tokens == len(own) and r.ids_crc32 == brute.crc(own[r.start : r.start + r.length])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for group, sizes in ((pieces, {i: len(x) + 1 for i, x in ids.items()}), (sequences, None)):
        for k, parts in group.items():
            at = 0
            for start, n in sorted(parts):
                assert start == at
                at += n
            assert at == sizes[k] if sizes else at <= 2048 and (at == 2048 or at & (at - 1) == 0)
    assert len(pieces) == len(ids)
    assert packing.packing(odd, TOKENIZER).where("start = 0").count() == 10
    assert packing.packing(none, TOKENIZER).count() == 0


def test_hilbert_is_a_curve():
    side = 8
    cells = np.array([(a, b, c) for a in range(side) for b in range(side) for c in range(side)])
    keys = packing.hilbert_key(cells, 3)
    path = cells[np.argsort(keys)]
    assert sorted(keys.tolist()) == list(range(side**3)) and (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_nbest(docs, odd, none):
    model = piece_nbest.PieceModel(PIECES)

    def every(text):
        text, out = (" " + text).replace(" ", piece_nbest.SPACE), []

        def go(i, score, ids):
            if i == len(text):
                out.append((score, tuple(ids)))
                return
            for j in range(i + 1, min(len(text), i + 16) + 1):
                if got := model.scores.get(text[i:j]):
                    go(j, score + got[1], [*ids, got[0]])
            if text[i] not in model.scores:
                ids2, s = model.spell(text[i])
                go(i + 1, score + s, [*ids, *ids2])

        go(0, 0.0, [])
        return sorted(out, reverse=True)

    encode = piece_nbest.NBestEncoder(PIECES, 4)
    for text in ("ab cd", "the of", "a\nb", "é ☃", "x", "one, two"):
        raw = np.frombuffer(text.encode(), np.uint8)
        best = next(iter(encode.encode(raw, np.array([0, len(raw)]))))
        want = every(text)
        assert [s for s, _ in best] == pytest.approx([s for s, _ in want[:4]])
        assert {tuple(i.tolist()) for _, i in best} <= {i for _, i in want}
    rows = piece_nbest.round_trip(docs, PIECES).collect()
    assert len(rows) == len(table_rows()) and all(r.decoded for r in rows)
    again = piece_nbest.decode(piece_nbest.encode_nbest(docs, PIECES, 2).where("rank = 1"), PIECES)
    assert {r.doc_id: r.text for r in again.collect()} == {i: t or "" for i, t in table_rows()}
    assert piece_nbest.round_trip(odd, PIECES).count() == 10 and piece_nbest.round_trip(none, PIECES).count() == 0


def test_language(spark, docs, none):
    big = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    rows = language_id.language_id(big).join(big.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    got = {r.doc_id: r for r in language_id.language_id(docs).collect()}
    assert [got[i].lang_pred for i in (5, 6, 7, 17)] == ["und"] * 4 and got[1].lang_pred == "en" and got[19].lang_pred == "en"
    assert language_id.language_id(none).count() == 0
    assert {r.lang_pred for r in language_id.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_neighbours(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    check_neighbours(df, 0.9)


def check_neighbours(df, least):
    rows = [(r.vec_id, r.embedding) for r in df.collect() if r.vec_id is not None and r.embedding and None not in r.embedding and np.isfinite(r.embedding).all() and any(r.embedding)]
    ids, unit = np.array([i for i, _ in rows]), neighbours.unit(np.array([v for _, v in rows]))
    got = defaultdict(list)
    for r in sorted(neighbours.nearest(df).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    hits = total = 0
    assert set(got) == {i for i in ids.tolist() if i % 50 == 0}
    for q, near in got.items():
        at = int(np.flatnonzero(ids == q)[0])
        scores = unit @ unit[at]
        order = [k for k in np.lexsort((ids, -np.round(scores, 12))) if k != at][:5]
        assert [s for _, s in near] == pytest.approx([scores[np.flatnonzero(ids == v)[0]] for v, _ in near], abs=1e-12)
        assert len(near) == len(order)
        hits, total = hits + len({ids[k] for k in order} & {v for v, _ in near}), total + len(order)
    assert hits >= least * total


def test_neighbours_in_parts(spark, monkeypatch):
    """Leaves and queries dealt out in many small parts find the same."""
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    monkeypatch.setattr(neighbours, "QUERY_PART", 3)
    check_neighbours(spark.read.parquet(f"{SMALL}/embeddings.parquet"), 0.9)


def test_neighbours_odd(spark):
    rng = np.random.default_rng(0)
    same = [float(x) for x in rng.standard_normal(8)]
    rows = [(i, [float(x) for x in rng.standard_normal(8)], 1) for i in range(120)] + [(200 + i, same, 1) for i in range(120)]
    rows += [(1000, None, 1), (1050, [0.0] * 8, 1), (1100, [float("nan")] + [1.0] * 7, 1), (1150, [None] + [1.0] * 7, 1), (1200, [1e200] * 8, 1), (None, same, 1)]
    check_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int"), 0.9)
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
    assert neighbours.nearest(spark.createDataFrame([(50, [1.0, 2.0])], "vec_id long, embedding array<double>")).count() == 0


ARTICLE = "<h1>Title &amp; more</h1><p>First paragraph, with commas, and enough text to count as prose.</p><p>Short.</p><p>Second  one,\n with &eacute; and more text, to the end."
PAGES = {
    1: f"<html><head><title>T</title><script>var a='</p>';</script></head><body><header><a href=/>Home</a></header><nav><ul><li><a href=x>Menu</a></li></ul></nav><article>{ARTICLE}</article><aside><p>Side text, long enough, with commas, many, of them.</p></aside><footer>&copy; me</footer></body></html>",
    2: f"<div id=top class='menu bar'><a href=1>One</a></div><div class=wrap><div class=story>{ARTICLE}<div class='ad-box'>Buy, now, this, thing, today.</div></div><div class=sidebar><p>Elsewhere, there is, other news, to read, at length.</p></div><div id=comments><p>I think, this comment, is long, and has commas, too.</p></div><form><p>Join our, newsletter, now, please, and more.</p></form></div><div class=cookie-notice>We use cookies</div>",
    3: None,
    4: "",
    5: "<nav><a href=x>only menu</a></nav>",
    6: f"<!-- c --><body><main>{ARTICLE}</main><div style='display:none'>hidden, text, here</div><!-- open",
}


def test_html(spark):
    pages = spark.createDataFrame([(i, f"u{i}", h, "x") for i, h in PAGES.items()] + [(1, "u1", PAGES[1], "x"), (None, None, "<p>bare", "x")], "page_id long, url string, html string, text string")
    got = html_text.html_text(pages).collect()
    main = "Title & more\n\nFirst paragraph, with commas, and enough text to count as prose.\n\nShort.\n\nSecond one, with é and more text, to the end."
    by = {r.page_id: r.text for r in got}
    assert [by[i] for i in (1, 2, 6)] == [main] * 3 and [by[i] for i in (3, 4, 5)] == [""] * 3 and by[None] == "bare"
    assert len(got) == 8 and all(r.n_chars == len(r.text) for r in got)


@pytest.mark.parametrize("page", ["<body><article><p>{0}</p>{1}<p>{0}</p></article></body>", "<body><div id=x><p>{0}</p>{1}<p>{0}</p></div></body>"])
@pytest.mark.parametrize(
    ("inner", "text"),
    [
        ("<h2 id='related-work'>Work</h2>", "Work"),
        ("<section class='discussion'><p>Said.</p></section>", "Said."),
        ("<p id='share-price'>Up.</p>", "Up."),
        ("<table><tr><td class='search'>Find</td></tr></table>", "Find"),
        ("<p class='notice-period'>Two months.</p>", "Two months."),
        ("<figure><figcaption>The bridge.</figcaption></figure>", "The bridge."),
        ("<ul><li><a href=x>One</a></li><li><a href=y>Two</a></li></ul>", "One\n\nTwo"),
        ("<p title=it's>That's it.</p>", "That's it."),
        ("<p title='a > b' data-x=\"it's\">More.</p>", "More."),
        ("<p>See <a href=x?a=b title=\"note>link</a> here.</p>", "See link here."),
        ("<h1 class=\"post-header\">Head</h1>", "Head"),
        ("<p>1 < 2 and a<b>c</b> </>end.</p>", "1 < 2 and ac end."),
        ("<div class='ad'>Buy</div>", None),
        ("<div class='related-posts'><a href=x>More</a></div>", None),
    ],
)
def test_html_keeps_the_text(page, inner, text):
    """Headings, paragraphs, cells, captions and lists of links in the text stay whatever their class or id."""
    assert html_text.main_text(page.format(ARTICLE_LINE, inner)) == "\n\n".join([ARTICLE_LINE, *([text] if text else []), ARTICLE_LINE])


ARTICLE_LINE = "The tide turned early, and the pilots waited for the wind to drop, as they do. " * 3 + "Then they left."


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<body><article><p>{0}</p></article><article><p>{0} Two.</p></article><article><p>{0} Three.</p></article></body>", ["{0}", "{0} Two.", "{0} Three."]),
        ("<main><h1>Title</h1><p>Lead.</p><article><p>{0}</p></article><section><p>Rest.</p></section></main>", ["Title", "Lead.", "{0}", "Rest."]),
        ("<main><div><h1>Title</h1></div><article><p>{0}</p></article><div class=related><p>Other things.</p></div></main>", ["Title", "{0}"]),
        ("<body><h1>Title</h1><article><p>{0}</p></article><p>After it.</p><article><p>Short.</p></article></body>", ["Title", "{0}", "After it.", "Short."]),
    ],
)
def test_html_articles_in_page_order(page, texts):
    assert html_text.main_text(page.format(ARTICLE_LINE)).split("\n\n") == [t.format(ARTICLE_LINE) for t in texts]


@pytest.mark.parametrize("end", ["<p class='x", "<a", "</p", "<!-- c", "<p title=\"a", "<br/"])
def test_html_cut_off(end):
    assert html_text.main_text(f"<article><p>{ARTICLE_LINE}</p>" + end) == ARTICLE_LINE


@pytest.mark.parametrize("tag", ["div", "b", "article", "p><div", "li"])
def test_html_nested_deeply(tag):
    assert html_text.main_text(f"<{tag}>" * 20000 + ARTICLE_LINE) == ARTICLE_LINE


def test_jaccard_of_one_id_with_two_texts(spark):
    """Each text of a doc_id is linked by itself: neither hides the other's links nor ties them together."""
    words = [[f"{x}{i}" for i in range(80)] for x in "ab"]
    texts = [" ".join(w) for w in words]
    near = [" ".join([*w[:78], "other"]) for w in words]
    rows = [(7, texts[0]), (7, texts[1]), (8, near[0]), (9, near[1]), (2, " ".join(["new", *words[1][2:]]))]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(2, 2), (7, 2), (7, 7), (8, 7), (9, 2)]


def test_jaccard_by_way_of_a_null_id(spark):
    """A row without doc_id links the rows on both sides of it, and belongs to their component."""
    words = [f"w{i}" for i in range(104)]
    left, right = [*(f"x{i}" for i in range(10)), *words[10:]], [*words[:93], *(f"y{i}" for i in range(11))]
    rows = [(1, " ".join(left)), (None, " ".join(words)), (None, " ".join(words)), (3, " ".join(right)), (None, "alone in here by itself now")]
    sets = [brute.shingles(t) for t in (rows[0][1], rows[1][1], rows[3][1])]
    alike = lambda x, y: 100 * len(x & y) >= 75 * len(x | y)
    assert alike(sets[0], sets[1]) and alike(sets[1], sets[2]) and not alike(sets[0], sets[2])
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((r.doc_id or 0), r.component_id or 0) for r in got) == [(0, 0), (0, 1), (0, 1), (1, 1), (3, 1)]


def test_language_of_few_documents_is_learned(spark):
    """However few documents a language has, the bounded sample holds some of it."""
    rows = [(i, prose(i, 20), "en") for i in range(300)] + [(1000 + 100 * k + i, prose(k, 20), f"l{k}") for k in range(4) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    known = {r.lang for r in docs.where(language_id.remainder() != 2).select("lang").distinct().collect()}
    assert len(known) == 5 and set(language_id.fit(docs, 15).langs) == known
