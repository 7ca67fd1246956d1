"""Files in the session's shared folder, written and mapped by tasks."""

from tillwise.sources.shared_files import as_uri, mapped, put  # noqa: F401
