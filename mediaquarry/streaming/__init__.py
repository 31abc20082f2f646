"""Streams of jobs, messages and log lines."""
