"""Generated texts that several tests of the training-data operators use."""

from __future__ import annotations

import random


def long_text(words: int, seed: int = 1, vocabulary: int = 500) -> str:
    draw = random.Random(seed)
    return " ".join(f"w{int(draw.expovariate(1) * vocabulary / 4) % vocabulary}" for _ in range(words))
