"""Random prose for the tests."""

import random

PROSE = "the quick brown fox jumps over a lazy dog while seven wise owls watch from tall old trees near calm water".split()


def prose(seed: int, n: int) -> str:
    """Random sentences of ordinary words."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        word = rng.choice(PROSE) + str(rng.randrange(40)) * (rng.random() < 0.3)
        out.append(word + rng.choice([" ", " ", " ", " ", ". ", ", ", ".\n"]) if k < n - 1 else word + ".")
    return "".join(out)
