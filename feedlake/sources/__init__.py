"""Scans: feed lists, feed documents, files and tables."""
