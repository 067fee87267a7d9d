"""Newick text: parsing and writing."""

from __future__ import annotations

from typing import NamedTuple


class Node(NamedTuple):
    node_id: str
    parent_id: str | None
    branch_length: float | None
    depth: int
    is_leaf: bool
    pre_ord: int


def parse(text: str) -> list[Node]:
    """Nodes in pre-order; unnamed inner nodes are called in_0, in_1, ... in that order."""
    at = 0
    nodes: list[dict] = []

    def name() -> str:
        nonlocal at
        if at < len(text) and text[at] in "'\"":
            mark, begin = text[at], at + 1
            at = text.index(mark, begin) + 1
            return text[begin : at - 1]
        begin = at
        while at < len(text) and text[at] not in "(),:;[":
            at += 1
        return text[begin:at].strip()

    def skip() -> None:
        nonlocal at
        while at < len(text) and (text[at].isspace() or text[at] == "["):
            at = text.index("]", at) + 1 if text[at] == "[" else at + 1

    stack: list[int] = []
    done: int | None = None
    skip()
    new = True
    while at < len(text) and text[at] != ";":
        c = text[at]
        if c == "(":
            nodes.append({"name": "", "parent": stack[-1] if stack else None, "length": None, "leaf": False})
            stack.append(len(nodes) - 1)
            at, new = at + 1, True
        elif c == ",":
            at, new = at + 1, True
        elif c == ")":
            if not stack:
                raise ValueError(f"unbalanced at {at}")
            done, at, new = stack.pop(), at + 1, False
        elif c == ":":
            at += 1
            skip()
            nodes[done]["length"] = float(name())
        elif new:
            nodes.append({"name": name(), "parent": stack[-1] if stack else None, "length": None, "leaf": True})
            done, new = len(nodes) - 1, False
        else:
            nodes[done]["name"] = name()
        skip()
    if stack:
        raise ValueError("a bracket isn't closed")
    free = 0
    for n in nodes:
        if not n["name"] and not n["leaf"]:
            n["name"], free = f"in_{free}", free + 1
    out: list[Node] = []
    for i, n in enumerate(nodes):
        p = n["parent"]
        out.append(Node(n["name"], None if p is None else nodes[p]["name"], n["length"], 0 if p is None else out[p].depth + 1, n["leaf"], i))
    return out


def write(nodes: list[tuple[str, str | None, float | None]], digits: int = 9) -> str:
    """The text of (node, parent, branch length); children in order of their names."""
    children: dict[str | None, list[tuple[str, float | None]]] = {}
    for n, p, b in nodes:
        children.setdefault(p, []).append((n, b))
    parts: list[str] = []
    todo: list[tuple] = [("open", *children[None][0])]
    while todo:
        what, n, b = todo.pop()
        mine = sorted(children.get(n, []))
        if what == "open" and mine:
            parts.append("(")
            todo.append(("close", n, b))
            for i, (c, l) in enumerate(reversed(mine)):
                todo.append(("open", c, l))
                if i < len(mine) - 1:
                    todo.append(("comma", "", None))
        elif what == "comma":
            parts.append(",")
        else:
            parts.append((")" if what == "close" else "") + n + ("" if b is None else f":{round(b, digits):g}"))
    return "".join(parts) + ";"
