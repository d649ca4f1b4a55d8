"""What a task keeps of scored rows: those that may be among the k best of a question."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Scores that are this near may swap when rounded to nine digits.
NEAR = 2e-9
#: Scores (rows by questions) that a task holds at once.
CELLS = 4_000_000


def keep(rows: pa.Table, k: int, floor: np.ndarray) -> tuple[pa.Table, np.ndarray]:
    """Of rows (i, ord, score and others) those that may be among the k best of question i, and the k-th score of each as far as it is known.

    Of equal scores the first k by ord stay (null first); all that are near the k-th stay, too.
    """
    rows = rows.append_column("_v", pc.is_valid(rows["ord"]).cast(pa.int8()))
    rows = rows.take(pc.sort_indices(rows, [("i", "ascending"), ("score", "descending"), ("_v", "ascending"), ("ord", "ascending")])).drop_columns(["_v"])

    def place(*same: np.ndarray) -> np.ndarray:
        """The number of each row among those before it that agree with it."""
        new = np.ones(len(same[0]), bool)
        new[1:] = np.any([s[1:] != s[:-1] for s in same], axis=0)
        start = np.flatnonzero(new)
        return np.arange(len(new)) - np.repeat(start, np.diff([*start, len(new)]))

    i, score = rows["i"].to_numpy(), rows["score"].to_numpy()
    own = np.flatnonzero(place(i, score) < k)
    i, score = i[own], score[own]
    last = place(i) == k - 1
    floor = floor.copy()
    floor[i[last]] = np.maximum(floor[i[last]], score[last])
    return rows.take(pa.array(own[score >= floor[i] - NEAR])), floor
