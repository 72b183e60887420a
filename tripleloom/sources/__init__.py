"""Readers and writers: Matrix Market text, binary CSR files, result tables, run logs, index pages."""
