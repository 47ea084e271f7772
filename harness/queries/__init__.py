"""Importing this package registers every query."""

from harness.queries import aggregates, jobs, joins, libraries, rows, validation, windows  # noqa: F401
