"""Min-cost flow over small integer networks: successive shortest augmenting paths with node potentials.

The networks hold one node per category or source, never per row, so they stay on the driver.
"""

from __future__ import annotations

import heapq
from collections.abc import Hashable


class Network:
    """Arcs with integer capacities and non-negative costs between nodes of any hashable name."""

    def __init__(self):
        self.out: dict[Hashable, list[int]] = {}
        self.head: list[Hashable] = []
        self.room: list[int] = []
        self.cost: list[float] = []

    def arc(self, tail: Hashable, head: Hashable, capacity: int, cost: float = 0) -> int:
        """Adds an arc and returns its handle for ``flow``."""
        at = len(self.head)
        for a, b, room, price in ((tail, head, capacity, cost), (head, tail, 0, -cost)):
            self.out.setdefault(a, []).append(len(self.head))
            self.out.setdefault(b, [])
            self.head.append(b)
            self.room.append(int(room))
            self.cost.append(price)
        return at

    def flow(self, arc: int) -> int:
        return self.room[arc ^ 1]

    def send(self, source: Hashable, sink: Hashable, amount: int) -> int:
        """Sends up to ``amount`` at least cost and returns what went through."""
        sent = 0
        height = dict.fromkeys(self.out, 0.0)
        while sent < amount and source in self.out:
            best: dict[Hashable, float] = {source: 0.0}
            via: dict[Hashable, int] = {}
            done = set()
            todo = [(0.0, 0, source)]
            order = 0
            while todo:
                d, _, u = heapq.heappop(todo)
                if u in done:
                    continue
                done.add(u)
                for a in self.out[u]:
                    v = self.head[a]
                    if self.room[a] > 0 and v not in done:
                        step = d + max(0.0, self.cost[a] + height[u] - height[v])
                        if step < best.get(v, float("inf")) - 1e-12:
                            best[v], via[v] = step, a
                            order += 1
                            heapq.heappush(todo, (step, order, v))
            if sink not in via:
                break
            for u in done:
                height[u] += best[u]
            far = max(best[u] for u in done)
            for u in self.out:
                if u not in done:
                    height[u] += far
            push, v = amount - sent, sink
            while v != source:
                push, v = min(push, self.room[via[v]]), self.head[via[v] ^ 1]
            v = sink
            while v != source:
                self.room[via[v]] -= push
                self.room[via[v] ^ 1] += push
                v = self.head[via[v] ^ 1]
            sent += push
        return sent
