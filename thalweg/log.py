"""Messages of long runs: off, printed, or handed to a function. Values of settings are never among them."""

from __future__ import annotations

import sys
from collections.abc import Callable

Log = Callable[[str], None]


def silent(message: str) -> None:
    """Says nothing."""


def to_stderr(message: str) -> None:
    print(message, file=sys.stderr, flush=True)


def switch(verbose: bool | Log) -> Log:
    return verbose if callable(verbose) else to_stderr if verbose else silent
