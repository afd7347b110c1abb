"""trackloom: record linkage, cleaning and comparison of media catalogues as Spark DataFrame plans."""

__version__ = "0.1.0"
