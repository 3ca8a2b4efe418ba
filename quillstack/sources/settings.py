"""Driver-side settings and file names: what is read once, before any table."""

from __future__ import annotations

import fnmatch
from pathlib import Path

Setting = str | list["Setting"] | dict[str, "Setting"]


def _value(text: str) -> str:
    text = text.strip()
    if text[:1] in ("'", '"') and text[0] in text[1:]:
        return text[1 : text.index(text[0], 1)]
    return text.split(" #", 1)[0].strip()


def settings(text: str) -> dict[str, Setting]:
    """The part of YAML that settings use: nested maps by indent, lists of scalars (one a line or in brackets), quoted or plain scalars, comments. All scalars are text."""
    root: dict[str, Setting] = {}
    open_maps: list[tuple[int, dict | list]] = [(-1, root)]
    waiting: tuple[dict, str] | None = None  # a key without a value: its map or list follows
    for line in text.splitlines():
        bare = line.strip()
        if not bare or bare.startswith("#"):
            continue
        indent = len(line) - len(line.lstrip(" "))
        is_item = bare == "-" or bare.startswith("- ")
        if waiting is not None:
            owner, key = waiting
            if indent > open_maps[-1][0] or (is_item and indent == open_maps[-1][0]):
                owner[key] = [] if is_item else {}
                open_maps.append((indent, owner[key]))
            waiting = None
        while len(open_maps) > 1 and (indent < open_maps[-1][0] or (indent == open_maps[-1][0] and isinstance(open_maps[-1][1], list) != is_item)):
            open_maps.pop()
        if open_maps[-1][0] < 0:
            open_maps[-1] = (indent, root)
        here = open_maps[-1][1]
        if is_item and isinstance(here, list):
            here.append(_value(bare[1:]))
        elif isinstance(here, dict):
            quote = bare[0] if bare[0] in "'\"" else ""
            key, _, rest = (bare[1:].partition(quote + ":") if quote else bare.partition(":"))
            key, rest = key.strip(), rest.strip()
            if not rest or rest.startswith("#"):
                here[key], waiting = "", (here, key)
            elif rest.startswith("["):
                here[key] = [v for v in map(_value, rest[1 : rest.rindex("]")].split(",")) if v]
            else:
                here[key] = _value(rest)
    return root


def setting(found: dict[str, Setting], dotted: str) -> Setting | None:
    """The value of a dotted name; None where it is missing or empty."""
    at: Setting | None = found
    for name in dotted.split("."):
        at = at.get(name) if isinstance(at, dict) else None
    return at or None


def manuals(folder: str, explicit: list[str] | None = None, pattern: str = "*.pdf") -> list[str]:
    """File names of a folder, sorted without regard to case; an explicit list goes before it, stripped, each name once, in its order."""
    if told := list(dict.fromkeys(s for s in (str(x).strip() for x in explicit or []) if s)):
        return told
    path = Path(folder)
    return sorted((p.name for p in path.glob(pattern) if p.is_file()), key=str.casefold) if path.is_dir() else []


def resolve(folder: str, name: str, listed: int = 25) -> Path:
    """The one file that a name stands for: exactly, else as a pattern, else as a part of a name. None or several is an error that lists them."""
    name = name.strip()
    name += "" if name.lower().endswith(".pdf") else ".pdf"
    here = sorted(p for p in Path(folder).iterdir() if p.is_file())
    for fits in (lambda p: p.name == name, lambda p: fnmatch.fnmatchcase(p.name, name), lambda p: fnmatch.fnmatchcase(p.name, f"*{name}*")):
        found = [p for p in here if fits(p)]
        if len(found) == 1:
            return found[0].resolve()
    if not found:
        raise FileNotFoundError(f"no file in {folder} for {name!r}")
    more = f" and {len(found) - listed} more" if len(found) > listed else ""
    raise FileNotFoundError(f"{name!r} may be any of {', '.join(p.name for p in found[:listed])}{more}")
