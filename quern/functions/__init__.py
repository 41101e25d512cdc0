"""Expressions over single values; all of them stay inside the JVM."""
