"""kmeridian: a Spark-native engine for genomic distance intervals and corpus preparation."""

__version__ = "0.1.0"
