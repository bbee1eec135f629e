"""skein: a Spark-first engine that builds, splits, scores and audits text corpora."""

__version__ = "0.1.0"
