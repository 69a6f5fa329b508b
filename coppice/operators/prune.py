"""Pruners on the node table. Trees are small: the driver walks them; only validation sums need the rows."""

from __future__ import annotations

from ..plans.model import Node


def collapse(nodes: dict[int, Node], at: int) -> None:
    """Makes a node a leaf that predicts its mean; its descendants go."""
    stack = [nodes[at].left, nodes[at].right]
    while stack:
        n = nodes.pop(stack.pop())
        if not n.is_leaf:
            stack += [n.left, n.right]
    nodes[at].make_leaf()


def bottom_up(nodes: dict[int, Node]) -> list[int]:
    return [n.node_id for n in sorted(nodes.values(), key=lambda n: (-n.depth, n.node_id)) if not n.is_leaf]


def leaves_below(nodes: dict[int, Node], at: int) -> list[Node]:
    out, stack = [], [at]
    while stack:
        n = nodes[stack.pop()]
        if n.is_leaf:
            out.append(n)
        else:
            stack += [n.left, n.right]
    return out


def cost_complexity(nodes: dict[int, Node], alpha: float) -> dict[int, Node]:
    """Collapses where metric * n + alpha is at most that of the leaves below, alpha counted once a leaf."""
    for k in bottom_up(nodes):
        leaves = leaves_below(nodes, k)
        if nodes[k].metric * nodes[k].samples + alpha <= sum(x.metric * x.samples for x in leaves) + alpha * len(leaves):
            collapse(nodes, k)
    return nodes


def reduced_error(nodes: dict[int, Node], seen: dict[int, tuple[float, float, float]]) -> dict[int, Node]:
    """Collapses where the squared error of the validation rows that reach a node does not grow. seen: n, sum, sum of squares."""

    def error(n: Node) -> float:
        c, a, b = seen.get(n.node_id, (0.0, 0.0, 0.0))
        return b - 2 * n.node_mean * a + c * n.node_mean * n.node_mean

    for k in bottom_up(nodes):
        if error(nodes[k]) <= sum(error(x) for x in leaves_below(nodes, k)) + 1e-12:
            collapse(nodes, k)
    return nodes
