"""Schemas: how the fields of an index are found, typed and analyzed."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from ..errors import SearchError

_TYPES = {"string": (0, None), "integer": (10, "integer"), "date": (10, "noop")}


@dataclass(frozen=True)
class Field:
    """``name`` may hold ``*`` (a dynamic field). ``inline``: 'no', 'yes' (indexed and carried on every posting) or 'only' (carried only)."""

    name: str
    type: str = "string"
    analyzer: str | None = None
    args: tuple[str, ...] = ()
    padding: int = 0
    aliases: tuple[str, ...] = ()
    inline: str = "no"
    skip: bool = False
    required: bool = False

    @property
    def dynamic(self) -> bool:
        return "*" in self.name

    def matches(self, name: str) -> bool:
        return any(_pattern(p).fullmatch(name) if "*" in p else p == name for p in (self.name, *self.aliases))


def _pattern(name: str) -> re.Pattern:
    return re.compile(name.replace("*", ".*"), re.S)


@dataclass(frozen=True)
class Schema:
    name: str
    fields: tuple[Field, ...]
    default_field: str = "value"
    default_op: str = "or"
    unique_key: str = "id"
    analyzer: str | None = None
    version: str = "1"
    n_val: int = 3

    def find(self, name: str) -> Field:
        """The first field in order of declaration that the name, or an alias, fits."""
        for f in self.fields:
            if f.matches(name):
                return f
        raise SearchError("missing_field", name)

    def canonical(self, name: str) -> str:
        """The name under which a field is indexed: that of a static field whose alias was used, else its own."""
        f = self.find(name)
        return name if f.dynamic else f.name

    def analysis(self, name: str) -> tuple[str, tuple[str, ...]]:
        f = self.find(name)
        analyzer = f.analyzer or self.analyzer
        if analyzer is None:
            raise SearchError("schema_setting_required", f"analyzer of {name}")
        return analyzer, f.args

    def with_options(self, default_field: str | None = None, default_op: str | None = None) -> Schema:
        if default_op not in (None, "and", "or"):
            raise SearchError("malformed_schema", f"default_op {default_op}")
        return replace(self, default_field=default_field or self.default_field, default_op=default_op or self.default_op)


def field(spec: Mapping[str, object]) -> Field:
    known = {"name", "type", "required", "skip", "aliases", "padding_size", "padding_char", "analyzer", "analyzer_args", "inline", "dynamic"}
    if unknown := set(spec) - known:
        raise SearchError("malformed_schema", f"unknown settings {sorted(unknown)}")
    kind = str(spec.get("type", "string"))
    if kind not in _TYPES:
        raise SearchError("malformed_schema", f"type {kind}")
    padding, analyzer = _TYPES[kind]
    padding = int(spec.get("padding_size", padding))
    char = str(spec.get("padding_char", "0" if kind != "string" else " "))
    if len(char) != 1:
        raise SearchError("bad_padding_char", char)
    if kind == "integer" and char != "0":
        raise SearchError("integer_fields_only_pads_with_zeros", char)
    name, aliases = str(spec["name"]), tuple(spec.get("aliases", ()))
    if "*" in name and aliases:
        raise SearchError("bad_alias_wildcard", name)
    args = spec.get("analyzer_args", ())
    if isinstance(args, str) or not all(isinstance(a, str) for a in args):
        raise SearchError("analyzer_args_must_be_strings", args)
    analyzer = str(spec["analyzer"]) if spec.get("analyzer") else analyzer
    if kind == "integer" and not args:
        args = (str(padding),)
    inline = {False: "no", True: "yes", "only": "only"}.get(spec.get("inline", False), "")
    if not inline:
        raise SearchError("malformed_schema", f"inline {spec['inline']}")
    return Field(name, kind, analyzer, tuple(args), padding, aliases, inline, bool(spec.get("skip", False)), bool(spec.get("required", False)))


def parse(name: str, settings: Mapping[str, object], fields: Sequence[Mapping[str, object]]) -> Schema:
    """A schema from plain settings (default_field, default_op, unique_key, analyzer, version, n_val) and field settings."""
    op = str(settings.get("default_op", "or")).lower()
    if op not in ("and", "or"):
        raise SearchError("malformed_schema", f"default_op {op}")
    if "default_field" not in settings:
        raise SearchError("malformed_schema", "default_field is missing")
    analyzer = settings.get("analyzer")
    return Schema(name, tuple(field(f) for f in fields), str(settings["default_field"]), op, str(settings.get("unique_key", "id")), str(analyzer) if analyzer else None, str(settings.get("version", "1")), int(settings.get("n_val", 3)))


def default(name: str) -> Schema:
    """Types by the ends of names: _num and _int, _dt and _date, _txt and _text; white space for all others."""
    rows = [*((f"*_{e}", "integer", None) for e in ("num", "int")), *((f"*_{e}", "date", None) for e in ("dt", "date")), *((f"*_{e}", "string", "standard") for e in ("txt", "text")), ("*", "string", "whitespace")]
    return parse(name, {"default_field": "value", "analyzer": "whitespace"}, [{"name": n, "type": t, "analyzer": a} for n, t, a in rows])
