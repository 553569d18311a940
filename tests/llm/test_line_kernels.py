"""Kernels of line dedup and of the pairs within lists: made for many texts at once, the same as for each alone."""

import numpy as np
import pyarrow as pa

from tidewatch.llm import line_dedup
from tidewatch.llm.jaccard_join import link_groups

TEXTS = ["abcdefghijkl", "", "abc", " \t", "abcdefgh", "éß\U0001f600 of twelve", "x" * 40, "tail"]


def test_hashes_of_lines_together_and_alone():
    joined = line_dedup.Lines(["\n".join(TEXTS), None, TEXTS[-1]])
    assert joined.bounds().tolist() == [0, 8, 9, 10]
    hashed, bounds = joined.shingles(np.arange(len(joined.start)))
    for k, text in enumerate([*TEXTS, "", TEXTS[-1]]):
        alone = line_dedup.Lines([text])
        own, _ = alone.shingles(np.arange(1))
        assert hashed[bounds[k] : bounds[k + 1]].tolist() == own.tolist() and len(own) == max(len(text) - line_dedup.SHINGLE + 1, 1)
        assert joined.classes()[k] == alone.classes()[0] and (alone.classes()[0] == 0) == (not text.strip(" \t"))


def test_lists_do_not_depend_on_pieces(monkeypatch):
    """Texts fall into pieces of their own, or all into one."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(range(8)), pa.array(["\n".join(TEXTS[:k]) or None for k in range(8)])], names=["first", "row", "text"])
    told = []
    for size in (1, 40, 1_000_000):
        monkeypatch.setattr(line_dedup, "PIECE_BYTES", size)
        lists = [line for out in line_dedup._line_classes(iter([batch])) for line in out.column("lines").to_pylist()]
        told.append((lists, [s.tolist() for s in line_dedup.line_sets(pa.chunked_array([pa.array(TEXTS[:3]), pa.array(TEXTS[3:])]))]))
    assert told[0] == told[1] == told[2] and [len(x) for x in told[0][0]] == [1, 1, 2, 3, 4, 5, 6, 7]


def _groups_table(n):
    rows = [(k, f"the same line of list {k} and some{'' if i else ' more'}", 2 * k + i) for k in range(n) for i in range(2)]
    whole = {"list": [r[0] for r in rows], "i": [0] * len(rows), "j": [0] * len(rows), "block": [0] * len(rows), "class": [r[2] for r in rows], "comp": [r[2] for r in rows], "node": [r[2] for r in rows]}
    return pa.table(whole | {"text": [r[1] for r in rows]})


def test_sets_of_small_groups_are_made_together(monkeypatch):
    calls = []

    def sets(texts):
        calls.append(len(texts))
        return line_dedup.line_sets(texts)

    want = [{2 * k, 2 * k + 1} for k in range(50)]
    assert [set(x) for x in link_groups(_groups_table(50), sets, None, 75)] == want and calls == [100]
    # beyond the bound a group stands alone, and finds the same
    monkeypatch.setattr("tidewatch.llm.jaccard_join.SETS_BYTES", 1)
    calls.clear()
    assert [set(x) for x in link_groups(_groups_table(50), sets, None, 75)] == want and calls == [2] * 50
