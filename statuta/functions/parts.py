"""Functions of texts over a few rows of an Arrow batch at a time: what a worker holds beside the batch follows this number."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa

#: Rows whose texts and results are Python objects at a time.
ROWS = 64


def mapped(f: Callable[..., Any], kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """f of every row; nulls are None."""
    made = []
    for at in range(0, len(columns[0]), ROWS):
        made.append(pa.array([f(*row) for row in zip(*(c.slice(at, ROWS).to_pylist() for c in columns))], kind))
    return pa.concat_arrays(made) if made else pa.array([], kind)
