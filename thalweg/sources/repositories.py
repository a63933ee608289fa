"""Repositories by folder or address: a folder is used as it is, an address is cloned once and then updated."""

from __future__ import annotations

import re
from collections.abc import Callable
from pathlib import Path

from .adapters import find_tool, run


def resolve(source: str, workdir: str = "repos", execute: Callable[[list[str], int], str | None] = run) -> Path:
    """The local folder of a repository; a shallow clone below workdir for an address, updated if it is there.

    An update that fails leaves the earlier state; a clone that fails is an error.
    """
    if Path(source).is_dir():
        return Path(source)
    if not re.match(r"^(?:https?|ssh|git)://|^git@", source):
        raise FileNotFoundError(f"{source} is neither a folder nor an address")
    name = re.sub(r"\.git$", "", source.rstrip("/").rsplit("/", 1)[-1])
    if not re.fullmatch(r"[A-Za-z0-9._-]+", name) or name in (".", ".."):
        raise ValueError(f"{source} has no usable name")
    target, git = Path(workdir) / name, find_tool("git") or "git"
    if (target / ".git").is_dir():
        execute([git, "-C", str(target), "pull", "--ff-only"], 300)
        return target
    target.parent.mkdir(parents=True, exist_ok=True)
    if execute([git, "clone", "--depth", "1", "--", source, str(target)], 600) is None:
        raise RuntimeError(f"{source} can't be cloned")
    return target
