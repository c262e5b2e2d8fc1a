"""Configuration of a crawl as YAML: typed keys, and an unknown one is an error."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields

import yaml

from auditloom.operators.catalog import check_overrides


@dataclass(frozen=True)
class Config:
    project_name: str | None = None
    max_urls: int | None = None
    max_depth: int | None = None
    max_duration_secs: int | None = None
    concurrency: int = 8
    user_agent: str | None = None
    ignore_robots: bool = False
    follow_external: bool = False
    check_external: bool = True
    max_external: int = 10_000
    max_external_urls: int | None = None
    respect_nofollow: bool = True
    include_patterns: list[str] = field(default_factory=list)
    exclude_patterns: list[str] = field(default_factory=list)
    discover_sitemaps: bool = True
    collect_body_text: bool = False
    rules: dict = field(default_factory=dict)

    def as_dict(self) -> dict:
        return asdict(self)


_KINDS = {"str": (str, "string"), "int": (int, "integer"), "bool": (bool, "boolean"), "list[str]": (list, "array"), "dict": (dict, "object")}


def _kind(annotation: str) -> tuple[type, str]:
    return _KINDS[annotation.removesuffix(" | None")]


def parse(text: str) -> Config:
    raw = yaml.safe_load(text) or {}
    if not isinstance(raw, dict):
        raise ValueError("a configuration is a mapping")
    known = {f.name: f for f in fields(Config)}
    if bad := sorted(set(raw) - set(known)):
        raise ValueError(f"unknown keys: {bad}")
    for k, v in raw.items():
        want = _kind(known[k].type)[0]
        if v is None and known[k].type.endswith("None"):
            continue
        if not isinstance(v, want) or (want is int and isinstance(v, bool)) or (want is list and not all(isinstance(x, str) for x in v)):
            raise ValueError(f"{k}: {want.__name__} expected")
        if want is int and v < 0:
            raise ValueError(f"{k}: must not be negative")
    c = Config(**raw)
    if not 1 <= c.concurrency <= 20:
        raise ValueError("concurrency: 1 to 20")
    check_overrides(c.rules)
    return c


def schema() -> dict:
    """A JSON schema of the configuration."""
    props = {f.name: {"type": _kind(f.type)[1]} | ({"items": {"type": "string"}} if _kind(f.type)[0] is list else {}) for f in fields(Config)}
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "type": "object", "additionalProperties": False, "properties": props}
