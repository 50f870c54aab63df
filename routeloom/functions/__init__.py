"""Scalar functions over columns; all of them stay in the JVM."""
