"""Typed access to nested configuration by dotted paths."""

from __future__ import annotations

from typing import Any

import yaml


class ConfigError(ValueError):
    """code: invalid_arg, parse_error, key_not_found, type_mismatch or out_of_range."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


_MISSING = object()


class Value:
    """A node: undefined, null, scalar, sequence or map."""

    def __init__(self, node: Any = _MISSING):
        self.node = node

    @property
    def kind(self) -> str:
        n = self.node
        return "undefined" if n is _MISSING else "null" if n is None else "map" if isinstance(n, dict) else "sequence" if isinstance(n, list) else "scalar"

    def __getitem__(self, key: str | int) -> Value:
        n = self.node
        if isinstance(n, dict) and key in n:
            return Value(n[key])
        if isinstance(n, list) and isinstance(key, int) and 0 <= key < len(n):
            return Value(n[key])
        return Value()

    def __len__(self) -> int:
        return len(self.node) if isinstance(self.node, (dict, list)) else 0

    def keys(self) -> list[str]:
        return list(self.node) if isinstance(self.node, dict) else []


class Config:
    def __init__(self, root: Any):
        self.root = root

    @classmethod
    def from_string(cls, text: str) -> Config:
        try:
            return cls(yaml.safe_load(text))
        except yaml.YAMLError as e:
            raise ConfigError("parse_error", str(e)) from e

    @classmethod
    def from_file(cls, path: str) -> Config:
        try:
            with open(path) as f:
                return cls.from_string(f.read())
        except OSError as e:
            raise ConfigError("invalid_arg", str(e)) from e

    def find(self, path: str) -> Value:
        """Digits index sequences; an empty segment is an invalid argument, anything not there is undefined."""
        at = Value(self.root)
        for part in path.split("."):
            if not part:
                raise ConfigError("invalid_arg", f"empty segment in {path!r}")
            at = at[int(part) if at.kind == "sequence" and part.isdigit() else part]
        return at

    def has(self, path: str) -> bool:
        return self.find(path).kind != "undefined"

    def get(self, path: str, kind: type = str) -> Any:
        v = self.find(path)
        if v.kind == "undefined":
            raise ConfigError("key_not_found", path)
        return _typed(v.node, kind, path)

    def get_or(self, path: str, default: Any) -> Any:
        """The default only where the path is absent; a wrong type still raises."""
        return self.get(path, type(default)) if self.has(path) else default

    def try_get(self, path: str, kind: type = str) -> Any | None:
        try:
            return self.get(path, kind)
        except ConfigError:
            return None

    def get_list(self, path: str, kind: type = str) -> list:
        v = self.find(path)
        if v.kind == "undefined":
            raise ConfigError("key_not_found", path)
        if v.kind != "sequence":
            raise ConfigError("type_mismatch", f"{path} is a {v.kind}")
        return [_typed(x, kind, path) for x in v.node]


def _typed(node: Any, kind: type, path: str) -> Any:
    if node is None or isinstance(node, (dict, list)):
        raise ConfigError("type_mismatch", f"{path} is not a scalar")
    if kind is str:
        return "true" if node is True else "false" if node is False else str(node)
    if kind is bool:
        if isinstance(node, bool):
            return node
    elif kind is int:
        if isinstance(node, int) and not isinstance(node, bool):
            if not -(1 << 63) <= node < 1 << 63:
                raise ConfigError("out_of_range", path)
            return node
    elif kind is float and isinstance(node, (int, float)) and not isinstance(node, bool):
        return float(node)
    raise ConfigError("type_mismatch", f"{path} is not {kind.__name__}")
