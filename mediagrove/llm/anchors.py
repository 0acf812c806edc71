"""Anchors: sampled byte strings that every repeated passage of ``length`` bytes must share."""

from __future__ import annotations

import numpy as np

from .kernel import U, _Powers, mix, salts
from .suffix_groups import ranges

LENGTH, GRAM = 50, 16
_BYTES = salts(256, 50)


class Anchors:
    """Each window of ``length`` bytes of one document has one anchor: the last gram of least hash in it.

    ``place``: where the gram begins; ``key``: its hash; ``doc``; ``first`` and ``last``: where the first and the last of its windows
    begin, which follow one another. Every window has exactly one anchor, so windows by anchor are as many as bytes at most, also
    in periodic texts; and equal windows have equal anchors at equal distances. Texts are read in runs of ``chunk`` bytes, so memory
    beyond the texts and the anchors doesn't grow with them.
    """

    def __init__(self, data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM, chunk: int = 1 << 16):
        n, width = len(data), length - gram + 1
        begins = np.ones(n, bool)  # a window may begin here
        size = np.diff(ends)
        short = np.minimum(size, length - 1)
        begins[ranges(ends[1:] - short, short)] = False
        none = np.zeros(0, np.int64)
        place, first, last, key = [none], [none], [none], [np.zeros(0, U)]
        for c in range(0, max(0, n - length + 1), chunk):
            part = data[c : c + chunk + length - 1]
            start = np.flatnonzero(begins[c : c + min(chunk, len(part) - length + 1)])
            if not len(start):
                continue
            up, down = _Powers.get(len(part) + 1)
            h = np.zeros(len(part) + 1, U)
            np.cumsum(_BYTES[part] * up[: len(part)], out=h[1:])
            grams = mix((h[gram:] - h[:-gram]) * down[: len(part) - gram + 1])
            low = U((1 << len(grams).bit_length()) - 1)
            least, done = (grams & ~low) | (low - np.arange(len(grams), dtype=U)), 1  # the low bits tell places, later ones less
            while done < width:  # the least of runs of neighbours, by doubling
                step = min(done, width - done)
                least = np.minimum(least[:-step], least[step:])
                done += step
            own = least[start]
            run = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            at = (low - (own[run] & low)).astype(np.int64)
            place.append(at + c)
            key.append(mix(grams[at] ^ U(0xC2B2AE3D27D4EB4F)))  # least hashes are small ones: spread them again
            first.append(start[run] + c)
            last.append(start[np.append(run[1:], len(start)) - 1] + c)
        place, first, last, key = map(np.concatenate, (place, first, last, key))
        new = np.ones(len(place), bool)  # a run of windows that crosses a cut is one
        new[1:] = place[1:] != place[:-1]
        run = np.flatnonzero(new)
        self.place, self.first, self.key = place[run], first[run], key[run]
        self.last = last[np.append(run[1:], len(place)) - 1] if len(run) else none
        self.doc = np.searchsorted(ends, self.place, "right") - 1
