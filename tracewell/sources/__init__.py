"""Readers that give ``lines`` (file, line_no, text), and writers."""
