"""sunloom: Spark-native analytics for unlabelled photovoltaic time series and large raw corpora."""

__version__ = "0.1.0"

import os

# One thread for a process' linear algebra, where NumPy is not loaded yet: tasks already use all cores.
for _name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):
    os.environ.setdefault(_name, "1")
