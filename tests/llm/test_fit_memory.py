import tracemalloc

import numpy as np
import pyarrow as pa

from xsecta.llm import quality


def test_fit_doesnt_copy_its_rows():
    rng = np.random.default_rng(3)
    rows = [(np.sort(rng.choice(1 << quality.BITS, 2_000, replace=False)).astype("<i4"), rng.random(2_000).astype("<f4")) for _ in range(1_500)]
    y, order = rng.integers(0, 2, len(rows)).astype(float), rng.permutation(len(rows))
    whole = pa.table({"y": y, "slots": pa.array([i.tobytes() for i, _ in rows], pa.binary()), "shares": pa.array([v.tobytes() for _, v in rows], pa.binary()), "order": order})
    got = pa.Table.from_batches(whole.to_batches(max_chunksize=400))
    fixed = 7 * 8 << quality.BITS  # state and weights, whatever the rows
    tracemalloc.start()
    out = quality._fit(got)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < fixed + 0.5 * got.nbytes, (peak, fixed, got.nbytes)
    by = np.argsort(order)
    want = quality.ftrl([(rows[k][0].astype(np.int64), rows[k][1].astype(float)) for k in by], y[by].tolist())
    assert np.frombuffer(out.column("weights")[0].as_py(), np.float32).tobytes() == want.weights.tobytes() and out.column("bias")[0].as_py() == want.bias
