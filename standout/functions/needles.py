"""Searching a text for many strings in one pass; used inside tasks."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

#: Leading characters by which the places of a needle are picked out; shorter needles are scanned for one by one.
HEAD = 4


class Needles:
    """A set of strings that is looked for in many texts, each text being passed once whatever the number of needles."""

    def __init__(self, needles: Iterable[str]):
        self.lengths: dict[str, set[int]] = {}
        for needle in needles:
            if len(needle) >= HEAD:
                self.lengths.setdefault(needle[:HEAD], set()).add(len(needle))
        self.may_start = np.zeros(1 << 16, bool)
        if self.lengths:
            self.may_start[self._hashed("".join(self.lengths))[::HEAD]] = True

    @staticmethod
    def _hashed(text: str) -> np.ndarray:
        """A hash of the HEAD characters from each place on."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        size = len(codes) - HEAD + 1
        out = np.zeros(size, np.uint32)
        for k in range(HEAD):
            out = (out + codes[k : k + size]) * np.uint32(2654435761)
        return out >> np.uint32(16)

    def places(self, text: str, wanted: Iterable[str]) -> dict[str, list[int]]:
        """0-based offsets of every hit, overlapping ones too, of each wanted needle, which must be of the set."""
        found: dict[str, list[int]] = {needle: [] for needle in wanted}
        for needle, at in found.items():
            if 0 < len(needle) < HEAD:
                place = text.find(needle)
                while place >= 0:
                    at.append(place)
                    place = text.find(needle, place + 1)
        if len(text) >= HEAD and self.lengths:
            for place in np.flatnonzero(self.may_start[self._hashed(text)]).tolist():
                for length in self.lengths.get(text[place : place + HEAD], ()):
                    at = found.get(text[place : place + length])
                    if at is not None and place + length <= len(text):  # the end of a text may cut a needle down to another
                        at.append(place)
        return found

    def counts(self, text: str, wanted: Iterable[str]) -> dict[str, int]:
        """Number of non-overlapping hits; an empty needle fits between all characters."""
        found = {}
        for needle, at in self.places(text, wanted).items():
            hits, free = 0, 0
            for place in at:
                if place >= free:
                    hits, free = hits + 1, place + len(needle)
            found[needle] = hits if needle else len(text) + 1
        return found


def random_place(doc_id: int, entity_id: int | None, text: str) -> tuple[int, int]:
    """Reproducible stand-in for a random word: blank before it up to the next blank."""
    at = 0 if entity_id is None else (doc_id * 31 + entity_id * 17) % len(text)
    start = max(text.rfind(" ", 0, at), 0)
    stop = text.find(" ", start + 1)
    return start, len(text) if stop < 0 else stop
