"""Functions of single values over Arrow arrays, a slice at a time."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa

#: Values that are Python objects at once. A batch has thousands, and texts and trees of them are far larger than in Arrow.
SLICE = 256


def by_slices(values: pa.Array, f: Callable[[Any], Any], kind: pa.DataType) -> pa.Array:
    """f of each value, as an array of a type; only a slice's values and results are Python objects at a time."""
    made = [pa.array([f(x) for x in values.slice(at, SLICE).to_pylist()], kind) for at in range(0, len(values), SLICE)]
    return pa.concat_arrays(made) if made else pa.array([], kind)
