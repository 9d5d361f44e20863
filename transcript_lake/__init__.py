"""Spark-native transcript and access-audit analytics.

Every operator is a plain function from DataFrame(s) to a DataFrame built on
Spark's own expressions. Clock reads are explicit ``as_of`` arguments so that
results can be repeated and checked against SQL.
"""

__version__ = "0.1.0"
