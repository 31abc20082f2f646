"""Operators over catalogs, searches, schedules and job logs."""
