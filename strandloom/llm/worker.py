"""Objects kept for the life of a Python worker."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import Any


def kept(key: str, make: Callable[[], Any]) -> Any:
    """``make()`` once per worker process. Task functions are unpickled for every task, so their own globals do not last."""
    store = sys.modules.setdefault("_strandloom_kept", types.ModuleType("_strandloom_kept"))
    if not hasattr(store, key):
        setattr(store, key, make())
    return getattr(store, key)
