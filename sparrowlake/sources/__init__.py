"""Catalogs, snapshot tables and their files."""
