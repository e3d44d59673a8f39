"""sparrowlake: a PySpark-native SQL engine over snapshot tables on Parquet."""

__version__ = "0.1.0"
