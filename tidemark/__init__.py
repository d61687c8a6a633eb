"""tidemark: seasonal anomaly analytics over daily sensor series, on Spark.

Every public function takes DataFrames and returns a DataFrame.  Nothing in
``functions``, ``operators`` or ``plans`` runs an action unless its docstring
says so; writing and reading files lives in ``sources`` and ``streaming``.
"""

from tidemark.settings import Settings

__all__ = ["Settings"]
__version__ = "0.1.0"
