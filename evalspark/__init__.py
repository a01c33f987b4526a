"""evalspark: DataFrame-to-DataFrame operators for evaluation analytics on Spark."""

__version__ = "0.1.0"
