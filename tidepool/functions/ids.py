"""Time-ordered identifiers."""

from __future__ import annotations

import os
import time
import uuid

UUID7 = r"^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"


def uuid7() -> str:
    """48 bits of milliseconds, version 7, the rest random: ids sort by creation."""
    value = int(time.time() * 1000) << 80 | int.from_bytes(os.urandom(10))
    value = value & ~(0xF << 76) | 7 << 76
    return str(uuid.UUID(int=value & ~(3 << 62) | 2 << 62))
