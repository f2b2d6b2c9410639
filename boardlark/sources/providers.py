"""What needs a network or a model outside: protocols and stand-ins for tests."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol


class Fetcher(Protocol):
    """Bytes and content type of a URL that safe_url() lets through, or None."""

    def fetch(self, url: str) -> tuple[bytes, str] | None: ...


class ImageReader(Protocol):
    def read(self, data: bytes, about: dict) -> str | None: ...


class Writer(Protocol):
    def write(self, about: dict, texts: list[str]) -> str | None: ...


@dataclass
class Scripted:
    """A language model that answers from a list, for tests."""

    replies: list[str | None]

    def complete(self, instructions: str, messages: list[dict[str, str]]) -> str | None:
        self.asked = [*getattr(self, "asked", []), (instructions, messages)]
        return self.replies.pop(0) if self.replies else None


def confidence(value: object) -> str:
    """high, medium or low; anything else is medium."""
    text = str(value or "").strip().lower()
    return text if text in ("high", "medium", "low") else "medium"
