"""quern: hybrid document search and large-scale data preparation on PySpark."""

__version__ = "0.1.0"
