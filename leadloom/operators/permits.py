"""Bounding the calls an executor makes at the same time.

A call holds one of ``n`` locked files in the temporary folder of its machine.  The
files are empty and only say who is calling: no data passes through them, and the
system frees the lock of a worker that dies.  Tasks keep their partitions, so
nothing is shuffled to slow down.
"""

from __future__ import annotations

import fcntl
import os
import random
import tempfile
import time
from collections.abc import Iterator
from contextlib import contextmanager

#: Seconds between two looks at the permits.
PAUSE = 0.005


def _executor() -> str:
    """What the workers of one executor have in common: the process that started their daemon."""
    return str(os.getppid())


@contextmanager
def permit(purpose: str, n: int | None) -> Iterator[None]:
    """Hold one of the executor's ``n`` permits for ``purpose``; None asks for none."""
    if not n:
        yield
        return
    folder = os.path.join(tempfile.gettempdir(), f"leadloom-permits-{purpose}-{_executor()}")
    os.makedirs(folder, exist_ok=True)
    while True:
        for k in random.sample(range(n), n):
            handle = os.open(os.path.join(folder, str(k)), os.O_CREAT | os.O_RDWR, 0o600)
            try:
                fcntl.flock(handle, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except OSError:
                os.close(handle)
                continue
            try:
                yield
            finally:
                os.close(handle)
            return
        time.sleep(PAUSE)
