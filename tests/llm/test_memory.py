"""What operator 8 holds beside its rows is bounded: by blocks of a long text, by symbols of a step."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from telemetra.llm import suffixes


def _peak(run):
    tracemalloc.start()
    out = run()
    size = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, size


@pytest.mark.parametrize(("words", "n", "gap"), [(False, 400, 256), (True, 51, 32)])
def test_a_long_text_is_parsed_in_blocks(words, n, gap, monkeypatch):
    draw = np.random.default_rng(5)
    text = b" ".join(bytes(draw.integers(97, 123, k).astype(np.uint8)) for k in draw.integers(1, 9, 4000).tolist()) * 100
    buffer, unit = suffixes._units(text, words)
    found, size = _peak(lambda: suffixes._triggers(buffer, unit, n, gap))
    assert size < 4 * len(buffer), size
    monkeypatch.setattr(suffixes, "BLOCK", len(buffer))
    for a, b in zip(found, suffixes._triggers(buffer, unit, n, gap), strict=True):
        assert (a == b).all()


def test_a_step_is_bounded_by_its_symbols(monkeypatch):
    draw = np.random.default_rng(6)
    k = 8000
    heads = [bytes(draw.integers(97, 123, 511).astype(np.uint8)) for _ in range(k // 2)]
    heads = [h for h in heads for _ in range(2)]
    rows = {"key": np.arange(k) // 4, "phrase": np.arange(k), "times": np.ones(k, np.int64), "starts": np.full(k, 256, np.int32), "head": heads, "tail": [b"t" * 400] * k}
    batch = pa.RecordBatch.from_pydict({c: pa.array(v) for c, v in rows.items()})
    found, size = _peak(lambda: pa.Table.from_batches(list(suffixes._repeated(iter([batch]), 400, 1))))
    assert size < 150e6, size
    assert found.column("key").to_pylist() == rows["key"].tolist() and len(set(found.column("again").to_pylist())) == 1
