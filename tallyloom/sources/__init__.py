"""Readers for tracker exports, word lists, INI page lists and HTML pages."""
