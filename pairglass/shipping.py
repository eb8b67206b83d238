"""Modules of this package for the executors' Python workers."""

from __future__ import annotations

import contextlib
import ctypes
import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def one_blas_thread() -> None:
    """Small linear algebra beside a running JVM: the threads of numpy's BLAS can stand still there, one can't."""
    import numpy as np

    for lib in Path(np.__file__).parent.parent.glob("numpy.libs/libscipy_openblas*"):
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(str(lib)).scipy_openblas_set_num_threads64_(1)


def ship(spark: SparkSession) -> None:
    """Give this package's modules to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    one_blas_thread()
    top = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(p.relative_to(top.parent)))
    path = Path(tempfile.mkdtemp(prefix="pairglass-ship-")) / "pairglass_modules.zip"
    path.write_bytes(data.getvalue())
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
