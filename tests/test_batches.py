"""What a task of parsed pages holds."""

from __future__ import annotations

import pyarrow as pa

from sheaf.sources import dom


def test_no_batch_is_held_while_the_next_is_read():
    """a batch of up to 10,000 pages stayed until the one after it was there."""
    before, held, rows = pa.total_allocated_bytes(), [], []

    def batches():
        for k in range(4):
            held.append(pa.total_allocated_bytes() - before)
            yield pa.record_batch([pa.array([f"{k}-{i}" + "x" * 10_000 for i in range(500)])], names=["html"])

    for part in dom.few_at_once(batches()):
        assert part.num_rows == dom.AT_ONCE
        rows += [t.rstrip("x") for t in part.column(0).to_pylist()]
    assert rows == [f"{k}-{i}" for k in range(4) for i in range(500)]
    assert max(held) < 1_500_000  # of 5 MB a batch
