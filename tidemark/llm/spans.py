"""What span finders share: digests and lists of spans in text."""

from __future__ import annotations

import hashlib

Span = tuple[str, int, int]


def ordered(spans: list[Span], kinds: list[str]) -> list[Span]:
    """By start, then kind as listed, then end; each span once."""
    return sorted(set(spans), key=lambda s: (s[1], kinds.index(s[0]), s[2]))


def listed(spans: list[Span]) -> str:
    """kind:start:end, joined by commas; characters, the end exclusive."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(listed(spans).encode()).hexdigest()


def apart(spans: list[Span], taken: list[Span]) -> list[Span]:
    """Those of spans that overlap none of taken."""
    return [s for s in spans if all(s[2] <= a or b <= s[1] for _, a, b in taken)]
