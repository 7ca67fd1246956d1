"""Intermediate tables in the session's shared folder."""

from tillwise.sources.staging import CLEANUP, Scratch, estimated_rows  # noqa: F401
