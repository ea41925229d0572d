"""The text-model client that a job is given. No model ships with the package."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol


class TextClient(Protocol):
    def generate(self, model: str, requests: list[list[dict]]) -> list[str]:
        """One reply to each request of a batch; a request is a list of role/content messages."""


ClientFactory = Callable[[], TextClient]
