"""Each stage of the pipeline against a plain version on its own input."""

import corpus_pipeline
from tests.llm import brute
from tidewatch.llm.common import materialize

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "jaccard_join", "suffix_dedup", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        columns = docs.columns
        docs = materialize(stage(spark, docs, SMALL), name)
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "line_dedup":
            cut = brute.dedup_lines(before)
            assert after == {i: t for i, t in cut.items() if t == dict(before)[i] or brute.WORD.search(t)}
            assert len(after) < len(before)  # exact copies lose all their lines
        elif name == "jaccard_join":
            assert set(after) == {i for i, (_, c) in brute.near_components(before).items() if c == i}
        elif name == "suffix_dedup":
            flags = brute.covered(before)
            cut = {i: brute.cut_text(t, flags[i]) for i, t in before}
            assert after == {i: t for i, t in cut.items() if t == dict(before)[i] or brute.WORD.search(t)}
        else:
            assert 0 < len(after) < len(before) and all(dict(before)[i] == t for i, t in after.items())
        assert all(r.n_chars == len(r.text) for r in docs.collect())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {r.doc_id for r in pieces} == set(after)


def test_one_of_each_of_repeated_rows(spark):
    """Rows that occur again, null ids and one id with several texts: one of each group stays, and nothing else goes."""
    words = [f"w{i}" for i in range(60)]
    a, near, b, c, d = " ".join(words), " ".join([*words[:58], "other"]), " ".join(f"b{i}" for i in range(30)), " ".join(f"c{i}" for i in range(30)), " ".join(f"d{i}" for i in range(30))
    rows = [(1, a)] * 50 + [(2, near), (2, b), (None, a), (None, c), (None, c), (3, d), (3, c.replace("c", "x")), (4, d), (5, ""), (5, ""), (5, " "), (6, None)]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, SMALL)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id or 0, r.text or "") for r in got.collect())) == sorted([(1, a), (2, b), (0, c), (3, d), (3, c.replace("c", "x")), (5, ""), (5, " "), (6, "")])
