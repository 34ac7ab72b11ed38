"""The routing topology: a declared table, checked once, walked for a decision, and drawn."""

from __future__ import annotations

END = "END"
START = "dedup"

#: Where each node may go on to.
SUCCESSORS: dict[str, tuple[str, ...]] = {
    "dedup": ("exposure",),
    "exposure": ("kill_switch",),
    "kill_switch": ("mode",),
    "mode": ("act", "human_review"),
    "act": ("explain",),
    "human_review": ("explain", END),
    "explain": ("ground",),
    "ground": (END, "template"),
    "template": (END,),
}


class BadTopology(ValueError):
    pass


def closure(table: dict[str, tuple[str, ...]], start: str) -> set[str]:
    """Everything that can come after ``start``."""
    found: set[str] = set()
    edge = [start]
    while edge:
        edge = [t for n in edge for t in table.get(n, ()) if t not in found]
        found.update(edge)
    return found


def check(table: dict[str, tuple[str, ...]] = SUCCESSORS, start: str = START) -> list[str]:
    """The nodes in name order; raises on the first property that doesn't hold."""
    for node, targets in table.items():
        for target in targets:
            if target != END and target not in table:
                raise BadTopology(f"{node} leads to {target}, which is no node")
    if start not in table:
        raise BadTopology(f"no start {start}")
    if lost := set(table) - closure(table, start) - {start}:
        raise BadTopology(f"never reached: {sorted(lost)}")
    if stuck := [n for n in table if END not in closure(table, n)]:
        raise BadTopology(f"never ends: {stuck}")
    if back := {"act", "mode"} & closure(table, "explain"):
        raise BadTopology(f"an explanation may not lead to {sorted(back)}")
    if table["explain"] != ("ground",):
        raise BadTopology("an explanation is always validated next")
    return sorted(table)


def walk(decision: str, halted: bool, grounded: bool = False) -> list[str]:
    """The nodes that a flag with this decision passes."""
    nodes = ["dedup", "exposure", "kill_switch", "mode", "act" if decision == "decline" else "human_review"]
    if halted and nodes[-1] == "human_review":
        return nodes
    return [*nodes, "explain", "ground", *([] if grounded else ["template"])]


def mermaid(table: dict[str, tuple[str, ...]] = SUCCESSORS) -> str:
    """The table as a flowchart."""
    return "\n".join(["flowchart TD", *(f"    {node} --> {target}" for node, targets in table.items() for target in targets)])


check()
