"""synthframe: profile, clean, encode, synthesize and evaluate tables on Spark."""

__version__ = "0.1.0"
