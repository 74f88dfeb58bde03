"""Typed errors."""


class GraphError(ValueError):
    """Something about a graph or an argument is wrong."""


class NodeNotFound(GraphError):
    """A node isn't in the graph."""


class EdgeNotFound(GraphError):
    """An edge isn't in the graph."""


class DirectionError(GraphError):
    """The operator needs the other kind of graph."""


class CycleError(GraphError):
    """A cycle where none may be; `cycle` lists its nodes, the first again at the end."""

    def __init__(self, cycle: list):
        super().__init__(f"the graph has a cycle: {' -> '.join(map(str, cycle))}")
        self.cycle = cycle


class NegativeWeightError(GraphError):
    """A negative weight where none may be."""


class NegativeCycleError(GraphError):
    """A cycle of negative weight."""


class NoPathError(GraphError):
    """No path joins two nodes."""


class NotConnectedError(GraphError):
    """The measure needs a connected graph."""


class ConvergenceError(GraphError):
    """An iteration didn't settle within its limit."""


class UnboundedFlowError(GraphError):
    """A path of unbounded capacity joins source and sink."""


class SizeLimitError(GraphError):
    """A group is too large for an in-memory kernel."""
