"""The same dataflow over unbounded input."""
