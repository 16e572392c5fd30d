"""Contents that a driver reads again and again, the least recently used dropped first."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterable


class DropCache:
    """Contents by id over a fetch of many; holds at most ``capacity`` of them."""

    def __init__(self, fetch: Callable[[list[str]], dict[str, bytes]], capacity: int = 256) -> None:
        if capacity < 1:
            raise ValueError("a cache holds one content at least")
        self._fetch, self._capacity = fetch, capacity
        self._held: OrderedDict[str, bytes] = OrderedDict()
        self.hits = self.misses = self.evicted = 0

    def get(self, ids: Iterable[str]) -> dict[str, bytes]:
        """The contents of the ids; those not held are fetched together. An unknown id is an error."""
        wanted = list(dict.fromkeys(ids))
        lacking = [i for i in wanted if i not in self._held]
        self.hits += len(wanted) - len(lacking)
        self.misses += len(lacking)
        found = self._fetch(lacking) if lacking else {}
        if unknown := [i for i in lacking if i not in found]:
            raise KeyError(f"no drop {unknown[0]}")
        out = {i: found[i] if i in found else self._held[i] for i in wanted}
        for i, content in out.items():
            self._held[i] = content
            self._held.move_to_end(i)
        while len(self._held) > self._capacity:
            self._held.popitem(last=False)
            self.evicted += 1
        return out

    def __len__(self) -> int:
        return len(self._held)
