"""The packer's choice against the rule said plainly."""

import numpy as np
import pytest

from tidebook.llm.packing import Item, Limits, Packer


def plainly(items, limits):
    """One sequence by the rule: the fitting item of largest dot product, else the longest one cut."""
    caps = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
    left, placed, items = caps.copy(), [], list(items)
    while items and left[0] > 0 and left[1] > 0:
        demand = np.array([(i.length, 1, i.loss) for i in items], float)
        fits = [k for k, d in enumerate(demand) if all(x <= y for x, y in zip(d, left, strict=True))]
        if fits:
            worth = demand @ (left / caps**2)
            best = max(fits, key=lambda k: (worth[k], -k))
            item, items[best] = items[best], items[-1]
            items.pop()
        else:
            best = int(demand[:, 0].argmax())
            size = items[best].head_within(int(left[0]), int(left[2]))
            if size == 0:
                break
            item, rest = items[best].cut(size)
            items[best] = items[-1]
            items[-1] = rest
        placed.append(item)
        left -= (item.length, 1, item.loss)
    return placed, items


@pytest.mark.parametrize("limits", [Limits(64, 256, 64), Limits(64, 4, 64), Limits(64, 8, 24)])
def test_each_sequence_follows_the_rule(limits):
    rng = np.random.default_rng(5)
    packer = Packer(limits, pool=1000)
    for k, (n, quiet) in enumerate(zip(rng.integers(1, 60, 150).tolist(), rng.integers(0, 3, 150).tolist(), strict=True)):
        for _ in packer.add(Item(k, 0, bytes(4 * n), min(quiet * n // 3, n), n)):
            raise AssertionError("the pool is not full yet")
    pool = list(packer._items)
    while pool:
        want, pool = plainly(pool, limits)
        assert packer._fill() == want
    assert not packer._items
