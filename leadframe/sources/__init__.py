"""Readers: HTML pages, listing profiles, JSON payloads, page series."""
