"""A radix trie over byte strings whose leaves count a term's documents and its occurrences by source."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


class Node:
    """``label``: the bytes between the parent and this node; ``counts``: None where no term ends here."""

    __slots__ = ("label", "edges", "docs", "counts")

    def __init__(self, label: bytes):
        self.label, self.docs = label, 0
        self.edges: dict[int, Node] | None = None
        self.counts: dict[int, int] | None = None


class Trie:
    """Tries of parts of a corpus merge into the trie of the whole: all counters are sums.

    The first ``HEAD`` bytes of a term are looked up at once; below them every node has an edge a byte.
    """

    HEAD = 3

    def __init__(self) -> None:
        self.heads: dict[bytes, Node] = {}
        self.leaves = 0

    def leaf(self, term: bytes) -> Node:
        """The node at which term ends, made if it is not there."""
        head = term[: self.HEAD]
        node, at, size = self.heads.get(head), len(head), len(term)
        if node is None:
            node = self.heads[head] = Node(head)
        while at < size:
            edges = node.edges
            if edges is None:
                edges = node.edges = {}
            byte = term[at]
            child = edges.get(byte)
            if child is None:
                node = edges[byte] = Node(term[at:])
                break
            label = child.label
            if term.startswith(label, at):
                at += len(label)
            else:  # the label is cut where it differs
                same = 1
                while at + same < size and label[same] == term[at + same]:
                    same += 1
                above = edges[byte] = Node(label[:same])
                child.label = label[same:]
                above.edges = {label[same]: child}
                child, at = above, at + same
            node = child
        if node.counts is None:
            node.counts = {}
            self.leaves += 1
        return node

    def add(self, docs: dict[bytes, int], by_source: Iterable[tuple[int, dict[bytes, int]]]) -> None:
        """Adds how many documents hold each term, and how often each source does; sources hold no other terms."""
        at = {term: self.leaf(term) for term in docs}
        for term, n in docs.items():
            at[term].docs += n
        for source, counted in by_source:
            for term, n in counted.items():
                counts = at[term].counts
                counts[source] = counts.get(source, 0) + n

    def walk(self) -> Iterator[tuple[bytes, Node]]:
        """Terms and their leaves in the order of the bytes, which of UTF-8 is that of the code points."""
        for head in sorted(self.heads):
            stack = [(b"", self.heads[head])]
            while stack:
                before, node = stack.pop()
                term = before + node.label
                if node.counts is not None:
                    yield term, node
                if node.edges:
                    stack.extend((term, node.edges[k]) for k in sorted(node.edges, reverse=True))

    def merge(self, other: Trie) -> None:
        for term, node in other.walk():
            self.add({term: node.docs}, [(source, {term: n}) for source, n in node.counts.items()])
