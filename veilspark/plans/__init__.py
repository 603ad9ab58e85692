"""The library's registered queries and their SQL."""
