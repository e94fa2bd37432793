"""Matching two lists one to one, where an item may suit several partners."""

from __future__ import annotations


def all_matched(suits: list[list[int]]) -> bool:
    """Whether every item finds a partner of its own; suits: of each item the numbers of the partners that suit it.

    Each item in turn looks for a free partner, breadth first along paths on which earlier
    items move to another partner (augmenting paths), so no order of the items matters.
    """
    owner: dict[int, int] = {}
    partner: dict[int, int] = {}
    for item in range(len(suits)):
        came: dict[int, int] = {}
        queue, free = [item], None
        for at in queue:
            for other in suits[at]:
                if other not in came:
                    came[other] = at
                    if other not in owner:
                        free = other
                        break
                    queue.append(owner[other])
            if free is not None:
                break
        if free is None:
            return False
        while free is not None:  # back along the path, each moves on to the partner just found
            at = came[free]
            owner[free] = at
            partner[at], free = free, partner.get(at)
    return True
