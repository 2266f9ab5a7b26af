"""Readers and writers: override tables, layouts, sessions, folders of files, chromatograms, result tables."""
