"""tabsmith: table-science operators for PySpark.

Profiling, cleaning, encoding, feature selection, model training, metrics,
model comparison, explanation jobs, drift, fairness and algorithm
recommendation -- every operator takes DataFrames and returns DataFrames.
"""

__version__ = "0.1.0"

from tabsmith.session import get_spark, checkpoint_dir  # noqa: F401
