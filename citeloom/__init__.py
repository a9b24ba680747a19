"""citeloom: novelty, disruption and data-processing operators for dated document corpora, on Spark DataFrames."""

__version__ = "0.1.0"
