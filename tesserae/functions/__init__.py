"""Scalar expressions: column in, column out, all inside the JVM."""
