"""Names in markup."""

from __future__ import annotations

_SITEMAP = "http://www.sitemaps.org/schemas/sitemap/"


def plain_location(tag: str) -> str:
    """A tag's name; that of another namespace than a sitemap's own keeps it, so that it is no location."""
    space, _, name = tag.rpartition("}")
    space = space.lstrip("{")
    return name if not space or space.startswith(_SITEMAP) else f"{space}:{name}"
