"""Exports of books, graphs and answers."""
