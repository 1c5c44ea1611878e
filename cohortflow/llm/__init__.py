"""Training-data pipeline operators.

Nothing else in the library imports this package; it may import the
library's general helpers. Each module holds one operator with its own
general interface; ``queries`` holds the registered queries and ``oracles``
their DuckDB SQL.
"""
