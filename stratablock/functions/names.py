"""Field names: what a file takes, without two that differ in case only."""

from __future__ import annotations

import re

MAX_NAME = 255
MAX_TRIES = 999


def _plain(name: str, number: int, strict: bool) -> str:
    name = name[:MAX_NAME] or f"Field_{number}"
    if strict:
        name = re.sub(r"[^A-Za-z0-9_]", "_", name)
        if not re.match(r"[A-Za-z_]", name):
            name = ("_" + name)[:MAX_NAME]
    return name


def _next_name(name: str, taken: set[str]) -> str:
    """name with the least number that is free: a lone digit 2-8 at its end goes on, other digits get _2, and so on."""
    m = re.search(r"(?<![0-9])([2-8])$", name)
    if m:
        root, first = name[:-1], int(m[1]) + 1
    elif re.search(r"[0-9]$", name):
        root, first = name + "_", 2
    else:
        root, first = name, 2
    for n in range(first, first + MAX_TRIES):
        made = f"{root}{n}" if n < 10 or root.endswith("_") else f"{name if root == name else root + '9'}{'9' if root == name else ''}_{n - 8}"
        made = made if len(made) <= MAX_NAME else made[len(made) - MAX_NAME :]
        if made.casefold() not in taken:
            return made
    raise ValueError(f"no free name for {name!r}")


def unique_names(names: list[str], strict: bool = False) -> list[str]:
    """Names for a file's fields, in order.  A given name goes before one made for another field."""
    plain = [_plain(n, i + 1, strict) for i, n in enumerate(names)]
    given = {p.casefold() for p in plain}
    seen: set[str] = set()
    out = []
    for p in plain:
        if p.casefold() in seen:
            p = _next_name(p, seen | given)
        seen.add(p.casefold())
        out.append(p)
    return out
