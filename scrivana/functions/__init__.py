"""Part of scrivana."""
