"""Bounds a job runs with.

These are features of the analysis, not shortcuts: crossing a *reject* bound turns the
message into a ``rejects`` row, crossing a *scan* bound leaves a ``warnings`` row.
"""

from __future__ import annotations

from dataclasses import dataclass

MIB = 1024 * 1024
#: No bound; larger than any size or count.
UNBOUNDED = 1 << 62


@dataclass(frozen=True)
class Limits:
    # Reject bounds: none unless the caller sets one.
    message_bytes: int = UNBOUNDED
    header_bytes: int = UNBOUNDED
    mime_parts: int = UNBOUNDED
    mime_depth: int = UNBOUNDED
    # Container bounds.
    archive_depth: int = 3
    archive_entries: int = 500
    nested_member_bytes: int = 10 * MIB
    # Awareness threshold for large attachments.
    oversized_bytes: int = 10 * MIB
    # URL scan bounds.
    text_parts: int = UNBOUNDED
    text_bytes: int = UNBOUNDED
    url_candidates: int = UNBOUNDED
    # Display width of the overview.
    display_chars: int = 200
