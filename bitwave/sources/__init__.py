"""Readers and writers: binary files, chunk streams, wave files."""
