"""Readers and writers: files in, typed tables out."""
