"""``python -m siftwright "<expression>"``: shows an expression's tree over a sample scheme, or why it does not parse."""

from __future__ import annotations

import json
import sys

from .errors import ParseError
from .functions.builtin import fail, standard
from .plans.nodes import stable_hash
from .scheme import SchemeBuilder
from .types import BOOL, BYTES, INT, IP, Array, Map

SAMPLE = {"ip": IP, "str": BYTES, "int": INT, "bool": BOOL, "str_arr": Array(BYTES), "str_map": Map(BYTES), "bool_arr": Array(BOOL), "int_arr": Array(INT)}


def main(args: list[str]) -> int:
    if not args:
        print(__doc__)
        return 2
    scheme = SchemeBuilder(SAMPLE).add_functions(standard()).add_function("panic", fail()).build()
    try:
        node = scheme.parse(args[0])
    except ParseError as e:
        print(e, end="", file=sys.stderr)
        return 1
    print(json.dumps(node.to_json(), indent=2, ensure_ascii=False))
    print(f"hash {stable_hash(node):016x}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
