"""The seeded 32-bit generator that clustering results depend on (the public-domain mulberry32)."""

from __future__ import annotations

_MASK = 0xFFFFFFFF


class Mulberry32:
    """Numbers in [0, 1), the same sequence for the same seed on every platform."""

    def __init__(self, seed: int):
        self.state = seed & _MASK

    def random(self) -> float:
        # the step, the shifts and the odd terms are fixed values of the generator
        self.state = (self.state + 0x6D2B79F5) & _MASK
        z = self.state
        z = ((z ^ z >> 15) * (z | 1)) & _MASK
        z ^= (z + (((z ^ z >> 7) * (z | 61)) & _MASK)) & _MASK
        return (z ^ z >> 14) / 2**32
