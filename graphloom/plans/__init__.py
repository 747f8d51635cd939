"""Registered queries: operators applied to whole tables, each with the SQL that gives the same rows."""
