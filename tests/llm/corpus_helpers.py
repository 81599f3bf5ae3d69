"""Made-up prose for the tests of the corpus operators."""

import random


def prose(seed: int, n: int) -> str:
    chance = random.Random(seed)
    return " ".join("".join(chance.choice("abdeilnorstu") for _ in range(chance.randint(2, 8))) for _ in range(n))
