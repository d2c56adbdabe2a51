"""Least squares from sums of products: one pass over the rows, small matrices solved where the plan is built."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gram(rows: DataFrame, x: str, targets: Sequence[str]) -> DataFrame:
    """(target, i, j, v): sums of x_i * x_j over the rows that know the target, the target itself being the last x.

    A task adds up its rows first, so the shuffle carries one matrix a task and target.
    """
    targets = list(targets)

    def run(batches):
        import pyarrow as pa

        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            z = np.stack(batch.column(0).to_numpy(zero_copy_only=False)).astype(float)
            for k in range(len(targets)):
                y = batch.column(k + 1).to_numpy(zero_copy_only=False).astype(float)
                ok = np.isfinite(y)
                a = np.column_stack([z[ok], y[ok]])
                total[k] = total.get(k, 0.0) + a.T @ a
        if total:
            p = len(next(iter(total.values())))
            i, j = np.divmod(np.arange(p * p), p)
            names = np.repeat([targets[k] for k in total], p * p)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names.tolist()), pa.array(np.tile(i, len(total)), pa.int32()), pa.array(np.tile(j, len(total)), pa.int32()), pa.array(np.concatenate([m.ravel() for m in total.values()]))],
                names=["target", "i", "j", "v"],
            )

    part = rows.select(x, *[F.col(t).cast("double") for t in targets]).mapInArrow(run, "target string, i int, j int, v double")
    return part.groupBy("target", "i", "j").agg(F.sum("v").alias("v"))


def least_squares(rows: DataFrame, x: str, targets: Sequence[str], penalty: float = 0.0) -> dict[str, list[float]]:
    """Weights of the array ``x`` for each target, with an L2 ``penalty`` on all but the first. The matrices, whose size is that of ``x``, come to the driver.

    Directions that the rows do not span get no weight. A target that no row knows is left out.
    """
    sums: dict[str, dict] = {}
    for r in gram(rows, x, targets).collect():  # one matrix a target
        sums.setdefault(r["target"], {})[r["i"], r["j"]] = r["v"]
    out = {}
    for t, v in sums.items():
        p = max(i for i, _ in v)
        a = np.array([[v[i, j] for j in range(p)] for i in range(p)])
        b = np.array([v[i, p] for i in range(p)])
        if a[0, 0] == 0 and not a.any():
            continue
        a += np.diag([0.0] + [penalty] * (p - 1))
        size = np.sqrt(np.maximum(np.diag(a), 1e-300))
        a = a / np.outer(size, size)  # columns of like size, so that small ones are not taken for none
        try:
            low = np.linalg.cholesky(a)
            if np.diag(low).min() < 1e-6:
                raise np.linalg.LinAlgError
            w = np.linalg.solve(low.T, np.linalg.solve(low, b / size))
        except np.linalg.LinAlgError:
            w = np.linalg.lstsq(a, b / size, rcond=1e-10)[0]
        out[t] = (w / size).tolist()
    return out
