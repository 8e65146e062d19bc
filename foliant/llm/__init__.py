"""Operators that prepare a training corpus; nothing outside this subpackage imports it."""
