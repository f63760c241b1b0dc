"""Sorting byte strings the deep-shallow way: multikey quicksort to a shallow depth, blind tries beyond it."""

from __future__ import annotations

SHALLOW = 16


def sort_suffixes(strings: list[bytes], shallow: int = SHALLOW, shared: int = 0) -> tuple[list[int], list[int]]:
    """The order of the strings, and the common prefix length of each with its predecessor (-1 for the first). The first `shared` bytes are known to be equal; `shallow` counts from there."""
    order: list[int] = []
    lcps: list[int] = []
    todo = [(list(range(len(strings))), shared, -1)]  # members, depth they share, common prefix of the first with what is before
    while todo:
        own, depth, before = todo.pop()
        if not own:
            continue
        if len(own) == 1:
            order.append(own[0])
            lcps.append(before)
        elif depth >= shared + shallow:
            blind_trie(strings, own, depth, before, order, lcps)
        else:
            pivot = _at(strings[own[len(own) // 2]], depth)
            less, same, more = [], [], []
            for i in own:
                c = _at(strings[i], depth)
                (same if c == pivot else less if c < pivot else more).append(i)
            # the last pushed comes first; a part that isn't the first shares `depth` bytes with its predecessor
            if more:
                todo.append((more, depth, depth))
            first = before if not less else depth
            if pivot < 0:
                todo.append((same[:1], depth, first))
                for i in same[1:]:
                    todo.insert(len(todo) - 1, ([i], depth, len(strings[i])))
            else:
                todo.append((same, depth + 1, first))
            if less:
                todo.append((less, depth, before))
    return order, lcps


def _at(s: bytes, k: int) -> int:
    return s[k] if k < len(s) else -1


class _Branch:
    """An inner node: the depth at which its strings part, and what follows by the byte there (-1: the end)."""

    __slots__ = ("depth", "below")

    def __init__(self, depth: int):
        self.depth, self.below = depth, {}


def blind_trie(strings: list[bytes], own: list[int], depth: int, before: int, order: list[int], lcps: list[int]) -> None:
    """Append the order of strings that share `depth` bytes. Branches skip the bytes between them; a descent compares
    one byte a branch, and the leaf it ends at tells the true common prefix. Leaves hold equal strings."""
    root: _Branch | list[int] = [own[0]]
    for i in own[1:]:
        s, node = strings[i], root
        while isinstance(node, _Branch):
            node = node.below.get(_at(s, node.depth)) or next(iter(node.below.values()))
        other = strings[node[0]]
        n = _common(s, other, depth)
        if n == len(s) == len(other):
            node.append(i)
            continue
        parent, key, at = None, None, root
        while isinstance(at, _Branch) and at.depth < n:
            parent, key = at, _at(s, at.depth)
            at = at.below[key]
        if isinstance(at, _Branch) and at.depth == n:
            at.below[_at(s, n)] = [i]
            continue
        branch = _Branch(n)
        branch.below = {_at(other, n): at, _at(s, n): [i]}
        if parent is None:
            root = branch
        else:
            parent.below[key] = branch
    todo: list[tuple[_Branch | list[int], int]] = [(root, before)]
    while todo:
        node, first = todo.pop()
        if isinstance(node, list):
            order += node
            lcps += [first, *[len(strings[node[0]])] * (len(node) - 1)]
        else:
            keys = sorted(node.below)
            for key in reversed(keys[1:]):
                todo.append((node.below[key], node.depth))
            todo.append((node.below[keys[0]], first))


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of strings that share `at` bytes."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = at, n
    while high - low > 1:
        m = (low + high) // 2
        if a[low:m] == b[low:m]:
            low = m
        else:
            high = m
    return low
