"""Requests of paginated sources: headers, bodies, and a loop that stops by itself. The fetcher is given, never built in."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import urlencode


def headers(method: str, etag: str | None, last_modified: str | None) -> dict[str, str]:
    """Conditional headers, on GET alone."""
    if method.upper() != "GET":
        return {}
    return {k: v for k, v in (("If-None-Match", etag), ("If-Modified-Since", last_modified)) if v}


def form_body(fields: dict[str, str], programmes: list[int], page: int) -> str:
    """A form body with repeated keys, in a fixed ascending order so that only the last page of a sweep changes."""
    return urlencode([*fields.items(), *(("programaId[]", str(p)) for p in sorted(programmes)), ("ordenacao", "asc"), ("pagina", str(page))])


def sweep(fetch: Callable[[int], list | None], cap: int, retries: int = 2) -> Iterator[tuple[int, list]]:
    """(page, items) from page 0 until an empty page or the cap; a page that fails is tried again, then ends the sweep."""
    for page in range(cap):
        items = None
        for _ in range(retries + 1):
            if (items := fetch(page)) is not None:
                break
        if not items:
            return
        yield page, items


def probe(baseline: list[str], variant: list[str] | None) -> str:
    """What a changed parameter did: broke the call, was ignored, or was understood."""
    return "quebrou" if variant is None else "ignorado" if variant == baseline else "reconhecido"
