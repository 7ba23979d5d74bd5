"""python -m quarry tokens|tree [FILE]: the tokens or the syntax trees of a script, from a file or standard input."""

from __future__ import annotations

import argparse
import sys

from quarry.errors import QuarryError
from quarry.plans.parser import parse
from quarry.plans.printer import statement_lines, token_lines


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quarry", description=__doc__)
    parser.add_argument("what", choices=["tokens", "tree"])
    parser.add_argument("file", nargs="?", type=argparse.FileType("r"), default=sys.stdin)
    chosen = parser.parse_args(args)
    text = chosen.file.read()
    try:
        lines = token_lines(text) if chosen.what == "tokens" else [x for statement in parse(text) for x in statement_lines(statement)]
    except QuarryError as e:
        print(e, file=sys.stderr)
        return 1
    print("\n".join(lines))
    return 0


if __name__ == "__main__":
    sys.exit(main())
