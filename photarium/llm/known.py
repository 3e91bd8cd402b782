"""A bounded memory of encoded words, for tasks that meet the same words again and again."""

from __future__ import annotations

from itertools import repeat

import numpy as np


class Known:
    """Keys to id sequences; when full, those met again stay."""

    def __init__(self, most: int):
        self.most = most
        self.at: dict = {}
        self.start, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.met = np.zeros(0, np.int64)

    def add(self, keys: list, size: np.ndarray, flat: np.ndarray) -> None:
        count = len(self.size)
        self.start = np.append(self.start, len(self.flat) + np.cumsum(size) - size)
        self.size, self.flat = np.append(self.size, size), np.append(self.flat, flat.astype(np.int32))
        self.met = np.append(self.met, np.zeros(len(keys), np.int64))
        self.at.update(zip(keys, range(count, count + len(keys))))

    def places(self, keys: list) -> np.ndarray:
        """Where the keys are, -1 for those that aren't."""
        return np.fromiter(map(self.at.get, keys, repeat(-1)), np.int64, len(keys))

    def meet(self, keys: list, place: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
        """place with the gaps filled, after the keys have been added; counts the meeting, or so many of each."""
        gaps = np.flatnonzero(place < 0)
        place[gaps] = np.fromiter(map(self.at.__getitem__, map(keys.__getitem__, gaps.tolist())), np.int64, len(gaps))
        np.add.at(self.met, place, 1 if times is None else times)
        return place

    def ids(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequences at these places, one after the other, and their sizes."""
        size = self.size[place]
        ends = np.cumsum(size)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[place] - ends + size, size)], size

    def trim(self, most: int | None = None) -> None:
        """Beyond that many keys, half of them stay."""
        most = most or self.most
        if len(self.at) > most:
            least = int(np.partition(self.met, len(self.met) - most // 2)[len(self.met) - most // 2]) + 1
            kept = [(k, i) for k, i in self.at.items() if self.met[i] >= least]
            place = np.array([i for _, i in kept], np.int64)
            (flat, size), met = self.ids(place), self.met[place]
            self.__init__(self.most)
            self.add([k for k, _ in kept], size, flat)
            self.met[:] = met // 2  # what was met long ago counts less
