"""Readers and parsers that turn raw statute files into node rows."""
