"""skein: partitioned, ordered collections on top of Spark DataFrames."""

from skein.dataset import Dataset
from skein.session import Context

__all__ = ["Context", "Dataset"]
