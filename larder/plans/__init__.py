"""Registered queries and the SQL for their rows."""
