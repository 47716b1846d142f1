"""All registered queries of the library, and their DuckDB SQL."""

from . import parsing, timed, triage

BOOKS = [parsing.book, triage.book, timed.book]
QUERIES = {name: f for book in BOOKS for name, f in book.queries.items()}
ORACLES = {name: sql for book in BOOKS for name, sql in book.oracles.items()}
