"""Scalar expressions, written as Spark SQL text.

Each function takes and returns an expression as text and callers put whole
projections of them into one ``selectExpr``. Spark parses a projection in one
call, where the same tree built operator by operator from Python would cost a
driver round trip per node; wide plans then spend seconds before they start.
Everything maps to JVM built-ins; there are no Python UDFs.
"""
