"""Configuration: YAML with named catalogs, ${ENVIRONMENT} values and account shorthands."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from typing import Any

import yaml

DEFAULT_PATH = "~/.sparrowlake/config.yaml"
PATH_VARIABLE = "SPARROWLAKE_CONFIG"


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class CatalogConfig:
    type: str = "rest"
    properties: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Config:
    catalogs: dict[str, CatalogConfig]
    default_catalog: str
    default_schema: str = "public"


def config_path() -> str:
    return os.path.expanduser(os.environ.get(PATH_VARIABLE) or DEFAULT_PATH)


def expand(text: str, env: dict[str, str] | None = None) -> str:
    """${NAME} from the environment, empty where unset; what is not closed stays as it is."""
    known = os.environ if env is None else env
    return re.sub(r"\$\{([^}]*)\}", lambda m: known.get(m[1], ""), text)


def _text(v: Any, env: dict[str, str] | None) -> str:
    return expand("true" if v is True else "false" if v is False else "" if v is None else str(v), env)


def parse(text: str, env: dict[str, str] | None = None) -> Config:
    text = text.removeprefix("\ufeff")
    if text.lstrip().startswith("{"):
        raise ConfigError("the configuration must be YAML, not JSON")
    try:
        raw = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ConfigError(f"cannot read the configuration: {e}") from e
    if not isinstance(raw, dict):
        raise ConfigError("the configuration must be a map")
    top = {str(k).lower().replace("_", "-"): v for k, v in raw.items()}
    found = top.get("catalogs")
    if not isinstance(found, dict) or not found:
        raise ConfigError("the configuration names no catalogs")
    catalogs = {}
    for name, body in found.items():
        values = {str(k): _text(v, env) for k, v in (body or {}).items()}
        kind = values.pop("type", "rest").lower()
        catalogs[str(name)] = CatalogConfig(kind, with_account(values) if kind == "rest" else values)
    default = _text(top.get("default-catalog"), env) or min(catalogs)
    if default not in catalogs:
        raise ConfigError(f"default catalog {default} is not among {sorted(catalogs)}")
    own = catalogs[default].properties
    return Config(catalogs, default, own.get("default-schema") or own.get("schema") or _text(top.get("default-schema"), env) or "public")


def load(path: str | None = None) -> Config:
    path = path or config_path()
    try:
        with open(path, encoding="utf-8") as f:
            return parse(f.read())
    except FileNotFoundError:
        raise ConfigError(f"no configuration at {path}") from None


def with_account(values: dict[str, str]) -> dict[str, str]:
    """An account and a token become a URI and a credential; values still to be filled in are an error."""
    out = dict(values)
    if "uri" not in out and (account := out.get("account")):
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", account):
            raise ConfigError(f"not an account: {account}")
        out["uri"] = f"https://{account}"
    if "credential" not in out and out.get("token"):
        out["credential"] = out.pop("token")
    for k, v in out.items():
        if re.fullmatch(r"<[^>]*>|YOUR_\w+|changeme", v, re.IGNORECASE):
            raise ConfigError(f"{k} is still to be filled in")
    return out
