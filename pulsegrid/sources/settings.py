"""Settings and thresholds: JSON with comments, overrides by tag, read again when a file changes."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, TypeVar

T = TypeVar("T")
_COMMENT = re.compile(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/|^\s*#[^\n]*', re.S | re.M)


def parse(text: str) -> dict[str, Any]:
    """JSON after removal of ``//``, ``/* */`` and leading ``#`` comments outside of strings."""
    return json.loads(_COMMENT.sub(lambda m: m[1] or "", text))


@dataclass
class Threshold:
    """A default with overrides by tag; the first tag in ``precedence`` that has one wins."""

    name: str
    default: float
    overrides: dict[str, dict[str, float]] = field(default_factory=dict)
    precedence: list[str] = field(default_factory=list)

    def value(self, tags: dict[str, str]) -> float:
        for tag in self.precedence:
            if tags.get(tag) in self.overrides.get(tag, {}):
                return self.overrides[tag][tags[tag]]
        return self.default


def tags_match(node: dict[str, str], host: dict[str, str]) -> bool:
    """Whether a host has every tag of a node; a node's tag may list values with commas."""
    return all(host.get(k) in v.split(",") for k, v in node.items())


class Settings:
    """A settings file that is read again once it has changed."""

    def __init__(self, path: str):
        self.path, self._seen, self._values = path, -1.0, {}

    def values(self) -> dict[str, Any]:
        if (changed := os.stat(self.path).st_mtime) != self._seen:
            with open(self.path) as f:
                self._values, self._seen = parse(f.read()), changed
        return self._values

    def get(self, section: str, key: str, default: T, valid: Callable[[T], bool] = lambda _: True) -> T:
        """A setting of the type of its default, or the default where it is missing or not valid."""
        got = self.values().get(section, {}).get(key, default)
        kinds = (int, float) if isinstance(default, float) else type(default)
        return got if isinstance(got, kinds) and valid(got) else default


def muted(names: set[str], enable: set[str], disable: set[str]) -> set[str]:
    """Muted names after an override that enables some and disables others."""
    return (names - enable) | disable
