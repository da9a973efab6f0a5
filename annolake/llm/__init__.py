"""Operators for training-text pipelines. Nothing outside this subpackage imports it."""
