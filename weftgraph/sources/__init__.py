"""Readers and parsers: source trees, history, test output, coverage, key shapes."""
