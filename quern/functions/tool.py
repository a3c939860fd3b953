"""What simulated tools have in common. A tool is a class whose ``state`` is plain data and whose public methods are calls."""

from __future__ import annotations

import copy


class Refused(Exception):
    """What a call returns as its error."""


def copied(x):
    """A deep copy of plain data."""
    if type(x) is dict:
        return {k: copied(v) for k, v in x.items()}
    if type(x) is list:
        return [copied(v) for v in x]
    return x if type(x) in (str, int, float, bool, type(None)) else copy.deepcopy(x)


class Tool:
    DEFAULT: dict = {}

    def __init__(self, config: dict | None = None):
        self.state = copied(self.DEFAULT) | copied({k: v for k, v in (config or {}).items() if k in self.DEFAULT})
        self._setup(config or {})

    def _setup(self, config: dict) -> None:
        pass

    def __getitem__(self, name: str):
        return self.state[name]

    def __setitem__(self, name: str, value) -> None:
        self.state[name] = value

    def _need(self, ok, error: str) -> None:
        if not ok:
            raise Refused(error)
