"""Names of places."""

from __future__ import annotations

from urllib.parse import urlsplit


def ends_with(text: object, end: str = "/") -> str:
    """``text`` with ``end`` behind it, once."""
    text = str(text)
    return text if text.endswith(end) else text + end


def local_path(path: str) -> str:
    """``scheme:/folder`` as the place under which the scheme is mounted: ``/scheme/folder``; other paths stay."""
    return "/" + path.replace(":", "") if ":" in path else path


def https_path(path: str) -> str:
    """``scheme://container@host/folder`` as ``https://host/container/folder``."""
    parts = urlsplit(path)
    if not parts.username or not parts.hostname:
        raise ValueError("the path must name a container and a host")
    return f"https://{parts.hostname}/{parts.username}{parts.path}"
