import ctypes
from pathlib import Path

import numpy as np
import pytest

from pairglass.shipping import one_blas_thread


def test_one_blas_thread():
    libs = list(Path(np.__file__).parent.parent.glob("numpy.libs/libscipy_openblas*"))
    if not libs:
        pytest.skip("another BLAS")
    lib = ctypes.CDLL(str(libs[0]))
    lib.scipy_openblas_set_num_threads64_(2)
    one_blas_thread()
    assert lib.scipy_openblas_get_num_threads64_() == 1
