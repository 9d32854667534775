"""Readers and writers: JSON requests, the event table, the rules table."""
