"""A group's rows of a micro-batch come in order and in small frames."""

from __future__ import annotations

import random

import pandas as pd
import pyarrow as pa

from quillon.streaming import state


def test_large_groups_come_in_frames():
    rng = random.Random(2)
    numbers = rng.sample(range(100_000), 25_000)
    batches = [pd.DataFrame({"sequence": numbers[i : i + 700], "record": [None if n % 9 == 0 else f"r{n}" for n in numbers[i : i + 700]]}) for i in range(0, len(numbers), 700)]
    frames = list(state.in_order(iter(batches), {"sequence": None, "record": pa.large_string()}, ("sequence",)))
    assert max(map(len, frames)) <= state.STEP and len(frames) > 2
    rows = pd.concat(frames)
    assert rows["sequence"].tolist() == sorted(numbers)
    assert rows["record"].tolist() == [None if n % 9 == 0 else f"r{n}" for n in sorted(numbers)]
    assert list(state.in_order(iter([]), {"sequence": None}, ("sequence",))) == []
