"""L-6: where user models live.

A factory is called once in each Python worker process, not once a task: workers
serve many tasks, and a model is kept there under its name.  Stages that run a
model can ask for executors of their own with a ``ResourceProfile``.
"""

from __future__ import annotations

import threading
from collections import OrderedDict
from collections.abc import Callable
from typing import TypeVar

Model = TypeVar("Model")

#: Models a worker keeps; the one longest unused goes first.
MAX_MODELS = 4

_lock = threading.Lock()
_models: OrderedDict[str, object] = OrderedDict()


def model_of_worker(name: str, factory: Callable[[], Model]) -> Model:
    """The model ``name`` of this process; ``factory()`` makes it the first time.
    A factory that raises leaves nothing behind, so a retried task calls it anew.
    The name must change with the weights (a path with a version, a digest)."""
    with _lock:
        if name not in _models:
            _models[name] = factory()
            while len(_models) > MAX_MODELS:
                _models.popitem(last=False)
        _models.move_to_end(name)
        return _models[name]


def once_per_worker(name: str | None, factory: Callable[[], Model]) -> Callable[[], Model]:
    """``factory`` as it is without a name, else its cached form."""
    return factory if name is None else lambda: model_of_worker(name, factory)
