"""python -m stratablock [--version | FILE]: the version, or a file's fields and number of records."""

from __future__ import annotations

import sys

from . import __version__, file_schema, num_records


def main(arguments: list[str]) -> int:
    if arguments == ["--version"]:
        print(__version__)
    elif len(arguments) == 1 and not arguments[0].startswith("-"):
        print(f"{num_records(arguments[0])} records")
        for f in file_schema(arguments[0]):
            print(f"{f.name}\t{f.type}" + (f"({f.size},{f.scale})" if f.type == "FixedDecimal" else f"({f.size})" if f.size else ""))
    else:
        print(__doc__)
        return 0 if arguments in ([], ["-h"], ["--help"]) else 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
