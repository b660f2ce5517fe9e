"""Readers: XML lists, request CSV, audit JSON lines, file inventory, seed rows."""
