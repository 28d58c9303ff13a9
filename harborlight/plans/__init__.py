"""Registered queries: operators wired to tables, each with its check SQL."""
