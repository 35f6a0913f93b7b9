"""Named queries over the harness tables, each with its SQL."""
