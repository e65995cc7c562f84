"""``${NAME}`` and ``${NAME:-default}`` in configuration text."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from typing import Any

PLACE = re.compile(r"\$\{([A-Za-z_]\w*)(?::-([^}]*))?\}")


def interpolate(config: Any, env: Mapping[str, str] | None = None, where: str = "configuration") -> Any:
    """``config`` with every string's placeholders filled; an unset name without a default is an error, odd placeholders stay."""
    env = os.environ if env is None else env

    def fill(m: re.Match) -> str:
        found = env.get(m[1], m[2])
        if found is None:
            raise KeyError(f"{where}: {m[1]} is not set")
        return found

    if isinstance(config, str):
        return PLACE.sub(fill, config)
    if isinstance(config, dict):
        return {k: interpolate(v, env, where) for k, v in config.items()}
    if isinstance(config, list):
        return [interpolate(v, env, where) for v in config]
    return config
