"""Pages for a sequence of blocks: the break points of least cost, by dynamic programming over each deck.

Decks are independent, so the work is parallel by deck; inside one the table of best
costs runs from the last block back. Costs are compared key by key: pages first, then
the largest page's demand, then the sum of squares of unused room.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def paginate(blocks: DataFrame, capacity: int, keys: tuple[str, str, str] = ("deck_id", "ord", "height")) -> DataFrame:
    """deck_id, ord, page (from 0) of every block; a block higher than a page has one of its own. A block counts one unit at least, so a page holds no more blocks than units. A deck's blocks meet in one task: decks are documents."""
    deck, order, height = keys

    def plan(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable")
        heights = [max(1, int(h)) for h in frame[height]]
        best: list[tuple] = [(0, 0, 0)] * (len(heights) + 1)
        step = [0] * len(heights)
        for i in range(len(heights) - 1, -1, -1):
            total, choice = 0, None
            for j in range(i + 1, len(heights) + 1):
                total += heights[j - 1]
                if total > capacity and j > i + 1:
                    break
                pages, most, waste = best[j]
                cost = (pages + 1, max(most, total), waste + max(0, capacity - total) ** 2)
                if choice is None or cost < choice:
                    choice, step[i] = cost, j
            best[i] = choice
        pages, page, at = [], 0, 0
        while at < len(heights):
            pages += [page] * (step[at] - at)
            at, page = step[at], page + 1
        return pd.DataFrame({deck: frame[deck].values, order: frame[order].values, "page": pages})

    types = dict(blocks.dtypes)
    return blocks.select(deck, order, height).groupBy(deck).applyInPandas(plan, f"`{deck}` {types[deck]}, `{order}` {types[order]}, page int")
