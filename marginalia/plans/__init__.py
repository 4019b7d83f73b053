"""Named queries: each module registers its own with the SQL it must agree with."""

from marginalia.plans import edits, fulltext, graphs, logs, ranking, relations, scalars, scans, search, sync  # noqa: F401
