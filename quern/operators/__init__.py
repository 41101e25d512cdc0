"""Relational, statistical and versioned operators as DataFrame functions."""
