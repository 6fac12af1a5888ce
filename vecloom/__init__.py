"""vecloom: DataFrame operators for collections of vector items."""

__version__ = "0.1.0"
