import os

import numpy as np
import pyarrow as pa

from geoloom.llm import _common as op


def resident() -> int:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")


def test_results_leave_in_batches_of_bounded_size():
    rows = np.arange(5_000_000)
    large = pa.RecordBatch.from_arrays([pa.array(rows), pa.array([b"x" * (k % 7) for k in range(len(rows))])], names=["a", "b"])
    empty = large.slice(0, 0)
    wide = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([b"y" * 2 * op.BATCH_BYTES, b"z"])], names=["a", "b"])
    out = list(op.Alone(lambda batches: batches, "")(iter([large, empty, wide])))
    assert all(b.nbytes <= 1.1 * op.BATCH_BYTES or b.num_rows == 1 for b in out)
    assert pa.Table.from_batches(out).equals(pa.Table.from_batches([large, empty, wide]))


def test_a_worker_gives_back_what_a_task_freed():
    kept = []

    def scattered(batches):
        own = [bytes(1000 + k % 100) for k in range(200_000)]
        kept.extend(own[::500])  # so that the heap's end stays in use
        del own
        yield from batches

    before = resident()
    assert not list(op.Alone(scattered, "")(iter([])))
    assert resident() - before < 60 << 20
