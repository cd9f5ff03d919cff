"""Readers and writers: bibliography files, tables, run reports."""
