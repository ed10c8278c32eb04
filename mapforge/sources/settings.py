"""Settings of the model clients from the environment and an optional file of ``KEY=VALUE`` lines."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path


def read_env_file(path: str | Path) -> dict[str, str]:
    """What the file sets; no file sets nothing. Blank lines, comments and lines without ``=`` are skipped, ``export`` and one pair of quotes dropped."""
    out: dict[str, str] = {}
    if not Path(path).exists():
        return out
    for raw in Path(path).read_text("utf-8").splitlines():
        name, sign, value = raw.strip().removeprefix("export ").partition("=")
        if sign and name.strip() and not name.startswith("#"):
            out.setdefault(name.strip(), value.strip().strip('"').strip("'"))
    return out


def environment(path: str | Path | None = None, real: Mapping[str, str] | None = None) -> dict[str, str]:
    """The real environment over what the file sets: a variable that is set stays, even if it is empty."""
    return {**(read_env_file(path) if path else {}), **(os.environ if real is None else real)}


def first_of(env: Mapping[str, str], names: Sequence[str], default: str | None = None) -> str | None:
    """The first of ``names`` that is not empty."""
    return next((env[n] for n in names if env.get(n)), default)


@dataclass(frozen=True)
class Endpoint:
    """Where a model answers. The key is in no text that this class makes."""

    url: str
    model: str
    key: str | None = field(default=None, repr=False)


def endpoint(env: Mapping[str, str], url: Sequence[str], key: Sequence[str], model: Sequence[str], default_url: str, default_model: str) -> Endpoint:
    """The first variable of each list that is not empty, else the default; there is no default key."""
    return Endpoint(first_of(env, url, default_url), first_of(env, model, default_model), first_of(env, key))
