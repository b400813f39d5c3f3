"""Readers and writers: bulk files, backup files, key-range dumps, profile records."""
