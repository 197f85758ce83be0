"""What a task holds beside its batch follows a piece of about 1 MB, not the batch."""

import pyarrow as pa

from shiftlens.llm import line_dedup
from shiftlens.llm.common import runs, slices


def test_runs_cover_everything_once():
    assert list(runs([])) == [] and list(runs([0, 0])) == [(0, 2)]
    assert list(runs([3, 9, 1, 1, 8], most=5)) == [(0, 1), (1, 2), (2, 4), (4, 5)]
    batch = pa.record_batch({"text": pa.array(["é", None, "", "abcd"])})
    assert list(slices(batch, "text", 3)) == [(0, 3), (3, 4)]


def test_line_chunks_come_piece_by_piece(monkeypatch):
    seen = []
    monkeypatch.setattr(line_dedup, "_versions", lambda *a: type("Rows", (), {"filter": lambda self, c: self})())
    monkeypatch.setattr(line_dedup.F, "col", lambda c: type("Text", (), {"contains": lambda self, x: None})())
    monkeypatch.setattr(line_dedup, "map_batches", lambda df, fn, schema: seen.append(fn))
    line_dedup.chunks(None)
    text = "\n".join(f"line {i} of a text" for i in range(6000))  # about 0.1 MB
    batch = pa.record_batch({"doc_id": pa.array(range(40)), "version": pa.array([0] * 40), "text": pa.array([text] * 40)})
    found = list(seen[0](iter([batch])))
    assert len(found) >= 4
    assert sorted({int(d) for part in found for d in part[2]}) == list(range(40))
    assert len({sum(int((part[2] == d).sum()) for part in found) for d in range(40)}) == 1
