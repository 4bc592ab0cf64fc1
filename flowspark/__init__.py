"""Network-flow analytics on Apache Spark.

Every operator takes a DataFrame and returns a DataFrame.  Operators that learn
something come in two halves: ``fit_*`` runs the aggregates and returns a small
parameter object, ``apply_*`` turns it into plain column expressions.
"""

__version__ = "0.1.0"
