"""Readers and writers."""

from .inbox import read_config, read_env, read_files, read_inbox, read_records, write_records

__all__ = ["read_config", "read_env", "read_files", "read_inbox", "read_records", "write_records"]
