"""Operators of a training-data pipeline.  Nothing else in the library imports this subpackage."""

import os

# numpy is called from many worker processes at once; its own threads would only compete
for _name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):
    os.environ.setdefault(_name, "1")
