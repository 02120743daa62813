"""Streams of documents and profiles."""
