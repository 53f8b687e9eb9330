"""Registered queries and their SQL, by area. Each module has QUERIES and ORACLE."""
