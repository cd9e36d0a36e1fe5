"""Readers of bibliographies, pages, books and element trees."""
