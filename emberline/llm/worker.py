"""Things that a Python worker builds once and keeps for its later tasks."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import Any


def kept(key: str, build: Callable[[], Any]) -> Any:
    """What ``build`` made for ``key`` in this process; keeps one object for each kind (the key up to its first ``:``)."""
    store = sys.modules.setdefault("_emberline_worker", types.ModuleType("_emberline_worker"))
    kind = key.partition(":")[0]
    if getattr(store, kind, (None,))[0] != key:
        setattr(store, kind, (key, build()))
    return getattr(store, kind)[1]
