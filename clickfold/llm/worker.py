"""What Python workers keep between tasks."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable

_NAME = "_clickfold_worker"


def kept(key: tuple, make: Callable[[], object]) -> object:
    """The object under ``key``, made on first use in this process.

    Task code arrives anew with every task, so its globals do not last; a module of the
    worker does. Use it for what depends on nothing but the key, such as a tokenizer and the
    words it has met.
    """
    module = sys.modules.get(_NAME)
    if module is None:
        module = sys.modules[_NAME] = types.ModuleType(_NAME)
        module.objects = {}
    if key not in module.objects:
        module.objects[key] = make()
    return module.objects[key]
