"""textfold: labelled-text preparation, folding, scoring and evaluation on Spark DataFrames.

Every operator is a pure ``DataFrame -> DataFrame`` transform built from Spark's
built-in expressions, so Catalyst can prune, push down and plan it. Tables carry a
string ``row_id``; anything random is a pure function of ``(seed, row_id)``.
"""

__version__ = "0.1.0"
