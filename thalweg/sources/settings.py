"""Settings files: NAME: value or NAME=value lines, with aliases; values are never logged."""

from __future__ import annotations

import os
import re
from pathlib import Path

ALIASES = {
    "LLM_API_KEY": ("LLM_API_KEY", "LLM_KEY", "API_KEY"),
    "LLM_MODEL": ("LLM_MODEL", "MODEL"),
    "LLM_BASE_URL": ("LLM_BASE_URL", "BASE_URL"),
    "CLASSIFIER_MODEL": ("CLASSIFIER_MODEL", "IMAGE_MODEL"),
}
_NAMES = {alias: name for name, all_ in ALIASES.items() for alias in all_}


def label(text: str) -> str:
    return re.sub("[^A-Z0-9]+", "_", text.strip().upper()).strip("_")


def parse(path: str | Path, names: dict[str, str] = _NAMES) -> dict[str, str]:
    """{setting: value}; an unknown label or a line of another form is an error."""
    found = {}
    for number, raw in enumerate(Path(path).read_text(encoding="utf-8-sig").splitlines(), 1):
        line = re.sub(r"(?i)^export\s+", "", raw.strip())
        if not line or line[0] == "#":
            continue
        name, mark, value = re.split("([:=])", line, maxsplit=1) if re.search("[:=]", line) else (line, "", "")
        if not mark or not name.strip():
            raise ValueError(f"{path}:{number}: NAME: value or NAME=value expected")
        if label(name) not in names:
            raise ValueError(f"{path}:{number}: unknown setting {name.strip()!r}; known are {', '.join(sorted(set(names.values())))}")
        value = value.strip()
        if value[:1] not in ("'", '"'):
            value = value.split(" #")[0].strip()
        if value := value.strip("'\""):
            found[names[label(name)]] = value
    return found


def find(given: str | None = None, places: tuple[Path, ...] = (Path("settings.txt"), Path.home() / ".config/thalweg/settings.txt")) -> Path | None:
    """The file that is given, or the first of the usual places that exists."""
    if given:
        if not Path(given).is_file():
            raise FileNotFoundError(given)
        return Path(given)
    return next((p for p in places if p.is_file()), None)


def load(given: str | None = None) -> list[str]:
    """Put the file's settings into the environment where they aren't set yet; names of those that were put."""
    path = find(given)
    new = [k for k in (parse(path) if path else {}) if not os.environ.get(k)]
    for k in new:
        os.environ[k] = parse(path)[k]
    return new


def take_option(argv: list[str], option: str = "--settings") -> tuple[str | None, list[str]]:
    """The value of option and the other arguments."""
    rest, value, it = [], None, iter(argv)
    for a in it:
        if a == option:
            value = next(it, None)
            if value is None:
                raise SystemExit(f"{option} needs a path")
        elif a.startswith(option + "="):
            value = a.split("=", 1)[1]
        else:
            rest.append(a)
    return value, rest
