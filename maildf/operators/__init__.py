"""Operators over frames of parsed messages."""

from .mail import attachments, explode_messages, explode_parts, from_json, to_json, write_attachments
from .threads import daily_counts, deduplicate, link_replies

__all__ = ["attachments", "daily_counts", "deduplicate", "explode_messages", "explode_parts", "from_json", "link_replies", "to_json", "write_attachments"]
