"""trendlens: Spark-native trend, regression and explanation analytics.

Every public operator takes a DataFrame and returns a lazy DataFrame (or a
fitted model whose result tables are lazy DataFrames).  Heavy work stays in
Spark jobs; only bounded things (level lists, p x p moment matrices, forest
node tables) are ever materialised outside of executors.
"""

from trendlens.roles import Roles
from trendlens.session import checkpoint_dir, get_spark

__all__ = ["Roles", "get_spark", "checkpoint_dir"]
