"""The BAI index: chunks of a region, counts, building, joining the indexes of parts.

A contig is cut into bins of six sizes, each eight times the next; a record belongs to the smallest bin that holds it
whole.  The index lists, by bin, the stretches of the file with its records, and for every window of 16,384 bases the
first record that overlaps it.  Positions are 0-based, ends exclusive.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

# fixed values of the format: bits of a bin's size and its first number, smallest bins first; the window; the bin of counts
LEVELS = ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1), (29, 0))
WINDOW = 14
COUNTS_BIN = 37450


def bin_of(start: int, end: int) -> int:
    """The smallest bin that holds ``[start, end)``."""
    for shift, first in LEVELS:
        if start >> shift == (end - 1) >> shift:
            return first + (start >> shift)
    return 0


def bins_over(start: int, end: int) -> set[int]:
    """All bins that may hold records overlapping ``[start, end)``."""
    return {first + k for shift, first in LEVELS for k in range(start >> shift, ((end - 1) >> shift) + 1)}


@dataclass
class ContigIndex:
    bins: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    windows: list[int] = field(default_factory=list)  # 0 where no record overlaps
    mapped: int = 0
    unmapped: int = 0
    span: tuple[int, int] | None = None

    def chunks(self, start: int, end: int) -> list[tuple[int, int]]:
        """Stretches of the file that hold every record overlapping ``[start, end)``, in order, joined where they touch."""
        first = start >> WINDOW
        # records that overlap the first window begin there or later; a window without records leaves it to the next
        least = next((v for v in self.windows[first:] if v), None)
        if least is None:
            return []
        wanted = bins_over(start, min(end, len(self.windows) << WINDOW))
        found = sorted((max(a, least), b) for number in wanted & self.bins.keys() for a, b in self.bins[number] if b > least)
        joined: list[tuple[int, int]] = []
        for a, b in found:
            if joined and a >> 16 <= joined[-1][1] >> 16:
                joined[-1] = (joined[-1][0], max(joined[-1][1], b))
            else:
                joined.append((a, b))
        return joined

    def add(self, start: int, end: int, place: int, after: int, mapped: bool) -> None:
        """Enter a record that lies between two virtual offsets; records come in order of start."""
        chunks = self.bins.setdefault(bin_of(start, end), [])
        if chunks and chunks[-1][1] >> 16 == place >> 16:
            chunks[-1] = (chunks[-1][0], after)
        else:
            chunks.append((place, after))
        last = (end - 1) >> WINDOW
        self.windows += [0] * (last + 1 - len(self.windows))
        for w in range(start >> WINDOW, last + 1):
            self.windows[w] = self.windows[w] or place
        self.mapped += mapped
        self.unmapped += not mapped
        self.span = (self.span[0] if self.span else place, after)

    def shifted(self, by: int) -> "ContigIndex":
        """The same for a file that begins ``by`` bytes later."""
        move = by << 16
        return ContigIndex(
            {k: [(a + move, b + move) for a, b in v] for k, v in self.bins.items()}, [w and w + move for w in self.windows],
            self.mapped, self.unmapped, self.span and (self.span[0] + move, self.span[1] + move))

    def join(self, later: "ContigIndex") -> None:
        """Add the index of a part that follows in the file."""
        for number, chunks in later.bins.items():
            self.bins.setdefault(number, []).extend(chunks)
        self.windows += [0] * (len(later.windows) - len(self.windows))
        for w, place in enumerate(later.windows):
            self.windows[w] = self.windows[w] or place
        self.mapped += later.mapped
        self.unmapped += later.unmapped
        if later.span:
            self.span = (self.span[0] if self.span else later.span[0], later.span[1])


@dataclass
class Index:
    contigs: list[ContigIndex]
    unplaced: int = 0

    @classmethod
    def empty(cls, n: int) -> "Index":
        return cls([ContigIndex() for _ in range(n)])

    @classmethod
    def parse(cls, data: bytes) -> "Index":
        if data[:4] != b"BAI\1":
            raise ValueError("no BAI index")
        at = 4

        def take(form: str) -> tuple:
            nonlocal at
            values = struct.unpack_from("<" + form, data, at)
            at += struct.calcsize("<" + form)
            return values

        contigs = []
        for _ in range(take("i")[0]):
            contig = ContigIndex()
            for _ in range(take("i")[0]):
                number, count = take("Ii")
                flat = take(f"{2 * count}Q")
                if number == COUNTS_BIN:
                    contig.span, (contig.mapped, contig.unmapped) = flat[:2], flat[2:4]
                else:
                    contig.bins[number] = list(zip(flat[::2], flat[1::2]))
            contig.windows = list(take(f"{take('i')[0]}Q"))
            contigs.append(contig)
        return cls(contigs, take("Q")[0] if len(data) - at >= 8 else 0)

    def serialize(self) -> bytes:
        out = [b"BAI\1", struct.pack("<i", len(self.contigs))]
        for contig in self.contigs:
            counted = contig.span is not None
            out.append(struct.pack("<i", len(contig.bins) + counted))
            for number, chunks in sorted(contig.bins.items()):
                out.append(struct.pack(f"<Ii{2 * len(chunks)}Q", number, len(chunks), *(v for c in chunks for v in c)))
            if counted:
                out.append(struct.pack("<Ii4Q", COUNTS_BIN, 2, *contig.span, contig.mapped, contig.unmapped))
            filled, last = [], 0
            for place in contig.windows:  # a window without records points to the one before, as readers expect
                last = place or last
                filled.append(last)
            out.append(struct.pack(f"<i{len(filled)}Q", len(filled), *filled))
        return b"".join(out) + struct.pack("<Q", self.unplaced)

    def join(self, later: "Index", shift: int) -> None:
        for own, other in zip(self.contigs, later.contigs):
            own.join(other.shifted(shift))
        self.unplaced += later.unplaced

    def cuts(self) -> list[int]:
        """Virtual offsets where records begin, ascending."""
        found = {w for c in self.contigs for w in c.windows if w}
        return sorted(found | {a for c in self.contigs for chunks in c.bins.values() for a, _ in chunks})
