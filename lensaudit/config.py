"""Settings: defaults, TOML files of user and project, environment variables and flags, later ones over earlier."""

from __future__ import annotations

import os
import re
import tomllib
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields, replace
from typing import Any

from . import fixed

ENV_PREFIX = "LENSAUDIT_"
PROJECT_FILE = "lensaudit.toml"
ENABLED = ("auto", "true", "false")
POLICIES = ("report", "fail", "ignore")


SECTIONS = ("audit", "fetch", "eval")


class ConfigError(ValueError):
    """Settings that cannot be used: exit code 2."""


@dataclass(frozen=True)
class Audit:
    max_pages: int = 10
    bots: tuple[str, ...] = ()
    policy: str = "report"
    fail_under: float | None = None
    only: tuple[str, ...] = ()
    skip: tuple[str, ...] = ()


@dataclass(frozen=True)
class Fetch:
    """As ``sources.fetch.Limits``; max_age: seconds after which a kept answer is fetched again."""

    delay: float = 0.2
    jitter: float = 0.5
    concurrency: int = 4
    timeout: float = 15.0
    max_bytes: int = 5_000_000
    redirects: int = 5
    allow_private: bool = False
    max_age: float | None = None


@dataclass(frozen=True)
class Eval:
    enabled: str = "auto"
    model: str | None = None
    judge_model: str | None = None
    embedding_model: str | None = None
    base_url: str | None = None
    api_key_env: str | None = None
    call_log: str | None = None
    eval_pages: int = 3
    questions: int = 50
    trials: int = 3
    top_k: int = 5
    facts: str | None = None
    max_cost: float | None = None
    fail_under_eval: float | None = None
    fail_under_eval_margin: float = 15.0
    strict_eval: bool = False
    input_cost_per_mtok: float | None = None
    output_cost_per_mtok: float | None = None


@dataclass(frozen=True)
class Config:
    audit: Audit = field(default_factory=Audit)
    fetch: Fetch = field(default_factory=Fetch)
    eval: Eval = field(default_factory=Eval)
    sources: tuple[str, ...] = ("defaults",)

    def public(self) -> dict[str, Any]:
        """What reports may show."""
        return asdict(self.audit)


def credentials(values: Any, path: str = "") -> list[str]:
    """Dotted keys of parsed settings under which a credential seems to stand: the key or the value
    has one of the fixed words. Empty values, none, null and references ($NAME) are no credentials."""
    if isinstance(values, Mapping):
        return [x for k, v in values.items() for x in credentials(v, f"{path}.{k}" if path else str(k))]
    if isinstance(values, list):
        return [x for v in values for x in credentials(v, path)]
    said = str(values).strip()
    if said.lower() in ("", "none", "null") or said.startswith("$"):
        return []
    name = path.rpartition(".")[2]
    return [path] if any(w in f"{name} {said}".lower() for w in fixed.SECRETS) else []


def _typed(section: Any, values: Mapping[str, Any]) -> Any:
    known = {f.name: f for f in fields(section)}
    out = {}
    for k, v in values.items():
        if k not in known:
            raise ConfigError(f"unknown setting {k!r}")
        if v is None:
            continue
        kind = str(known[k].type)
        try:
            if "tuple" in kind:
                v = tuple(x.strip() for x in v.split(",")) if isinstance(v, str) else tuple(map(str, v))
            elif kind.startswith("bool"):
                v = v if isinstance(v, bool) else str(v).lower() in ("1", "true", "yes")
            elif kind.startswith("int"):
                v = int(v)
            elif kind.startswith("float"):
                v = float(v)
            else:
                v = str(v)
        except (TypeError, ValueError) as e:
            raise ConfigError(f"{k}: {e}") from e
        out[k] = v
    return replace(section, **out)


def override(cfg: Config, values: Mapping[str, Mapping[str, Any]], source: str) -> Config:
    """``cfg`` with values by section; None means not given."""
    if bad := set(values) - set(SECTIONS):
        raise ConfigError(f"unknown sections {', '.join(sorted(bad))}")
    got = replace(cfg, **{k: _typed(getattr(cfg, k), v) for k, v in values.items()})
    if min(got.fetch.concurrency, got.fetch.max_bytes) < 1 or min(got.fetch.delay, got.fetch.jitter, got.fetch.redirects) < 0 or got.fetch.timeout <= 0:
        raise ConfigError("concurrency, max_bytes, delay, jitter, redirects or timeout is out of range")
    if got.eval.enabled not in ENABLED or not 1 <= got.eval.questions <= 200 or got.eval.eval_pages < 1:
        raise ConfigError("enabled is auto, true or false; questions 1 to 200; eval_pages 1 or more")
    if got.audit.policy not in POLICIES or got.audit.max_pages < 1 or min(got.eval.trials, got.eval.top_k) < 1:
        raise ConfigError("policy, max_pages, trials or top_k is out of range")
    return replace(got, sources=(*cfg.sources, source)) if got != cfg else cfg


def files(path: str | None, env: Mapping[str, str]) -> list[str]:
    """Settings files, later ones over earlier: the user's, then the one that is named, else the
    project's. Those not named need not be there."""
    home = env.get("XDG_CONFIG_HOME") or (os.path.join(env["HOME"], ".config") if env.get("HOME") else None)
    user = [os.path.join(home, "lensaudit", "config.toml")] if home else []
    named = path or env.get(ENV_PREFIX + "CONFIG")
    return [p for p in user + ([] if named else [PROJECT_FILE]) if os.path.isfile(p)] + ([named] if named else [])


def load(path: str | None = None, env: Mapping[str, str] | None = None) -> Config:
    cfg, env = Config(), os.environ if env is None else env
    for path in files(path, env):
        try:
            with open(path, encoding="utf-8") as f:
                text = f.read()
            values = tomllib.loads(text)
            if found := credentials(values):
                raise ConfigError(f"{path} contains what look like credentials ({', '.join(sorted(set(found)))})")
            cfg = override(cfg, values, path)
        except (OSError, tomllib.TOMLDecodeError) as e:
            raise ConfigError(f"{path} cannot be read: {e}") from e
    layer: dict[str, dict[str, str]] = {}
    for section in SECTIONS:
        for f in fields(getattr(cfg, section)):
            if v := env.get(ENV_PREFIX + re.sub("^eval_", "", f.name).upper()):
                layer.setdefault(section, {})[f.name] = v
    return override(cfg, layer, "env") if layer else cfg


def starter() -> str:
    """A settings file with every default, those without one as comments."""
    lines = []
    for section in SECTIONS:
        lines.append(f"[{section}]")
        for k, v in asdict(getattr(Config(), section)).items():
            if v is None:
                lines.append(f"# {k} =")
            else:
                lines.append(f"{k} = {str(v).lower() if isinstance(v, bool) else list(v) if isinstance(v, tuple) else repr(v).replace(chr(39), chr(34))}")
        lines.append("")
    return "\n".join(lines)
