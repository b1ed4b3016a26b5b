"""Blocking programs over a streamed search side."""
