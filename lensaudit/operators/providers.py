"""Which model a run without settings would use: the first provider whose key is set."""

from __future__ import annotations

from collections.abc import Mapping

from .. import fixed


def key_matches(name: str, base: str) -> bool:
    """The documented variable, or it with a suffix after an underscore."""
    return name == base or name.startswith(base + "_")


def detect(env: Mapping[str, str]) -> tuple[str, str, str | None, str | None] | None:
    """(key variable, model, base URL, embedding model): exact names first, then suffixed ones,
    each in the order of the registry."""
    return next((p for p in fixed.PROVIDERS if env.get(p[0])), None) or next((p for p in fixed.PROVIDERS if any(v and key_matches(k, p[0]) for k, v in env.items())), None)


def endpoint(model: str, env: Mapping[str, str], base_url: str | None = None, key_env: str | None = None) -> tuple[str, str | None]:
    """(base URL, key) for ``model`` (provider/name): the given ones, else those of its provider."""
    provider = model.partition("/")[0]
    url = base_url or fixed.ENDPOINTS.get(provider)
    if not url:
        raise ValueError(f"no endpoint is known for {model}; give --base-url")
    name = key_env or (next((k for host, k in fixed.ENDPOINT_KEYS if host in url.lower()), None) if base_url else next((p[0] for p in fixed.PROVIDERS if p[1].startswith(provider + "/")), None))
    return url, next((v for k, v in sorted(env.items()) if name and v and key_matches(k, name)), None)
