"""Pool-based active learning over very large candidate tables, as Spark DataFrame operators."""

__version__ = "0.1.0"
