"""driftwalk: random-walk corpora over changing graphs, as Spark DataFrames."""

from driftwalk.config import WalkConfig

__all__ = ["WalkConfig"]
