"""What a stage of the ranked search hands on lies document by document."""

from __future__ import annotations

import pandas as pd

from trailmill.llm import search

ACC = ["_item", "_row", "_d", "_dn", "acc"]


def test_bundles_lie_by_document():
    items = [3, 1, 2]
    acc = pd.DataFrame([(i, row, row, False, 5) for i in items for row in (9, 4)], columns=ACC)
    posts = pd.DataFrame([(0, 7, row, row, False, 10, -1, 0) for row in (9, 4, 6)], columns=["kind", "tk", "_row", "_d", "_dn", "v", "_item", "qtf"])
    asked = pd.DataFrame([(1, 7, -1, 0, False, 0, i, i) for i in items], columns=posts.columns)
    out = search._stage(False, 10)(None, acc, pd.concat([posts, asked]))
    assert list(zip(out["_row"], out["_item"], out["acc"])) == [
        (row, i, 10 * i + (0 if row == 6 else 5)) for row in (4, 6, 9) for i in (1, 2, 3)
    ]
