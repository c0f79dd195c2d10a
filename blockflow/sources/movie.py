"""The boxes of a movie file with one video track, from its table of samples."""

from __future__ import annotations

from itertools import groupby

MEDIA, MOVIE = 90_000, 1_000  # ticks a second
NAME = b"blockflow"
_MATRIX = b"".join(n.to_bytes(4, "big") for n in (0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000))


def u16(*numbers: int) -> bytes:
    return b"".join(n.to_bytes(2, "big") for n in numbers)


def u32(*numbers: int) -> bytes:
    return b"".join(n.to_bytes(4, "big") for n in numbers)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return u32(8 + len(body)) + kind + body


TYPES = box(b"ftyp", b"mp42", u32(0), b"mp42isomavc1")


class Samples:
    """Sizes, synchronisation points and times of samples in order, and the first parameter sets: 16 bytes a sample or less."""

    def __init__(self):
        self.sizes: list[int] = []
        self.syncs: list[int] = []
        self.deltas: list[int] = []
        self.last: int | None = None
        self.size: tuple[int, int] | None = None
        self.sets: dict[bool, bytes] = {}
        self.bytes = 0

    def parameters(self, sequence: bool, unit: bytes) -> None:
        self.sets.setdefault(sequence, unit)

    def add(self, size: int, sync: bool, ticks: int, width: int, height: int) -> None:
        if len(self.sets) < 2:
            raise ValueError("the first access unit must hold sequence and picture parameter sets")
        if not size:
            raise ValueError("an access unit without a coded slice")
        if self.last is not None:
            self.deltas.append(max(1, ticks - self.last))  # time runs forward
        self.size = self.size or (width, height)
        self.last = ticks
        self.sizes.append(size)
        self.bytes += size
        if sync:
            self.syncs.append(len(self.sizes))

    @property
    def wide(self) -> bool:
        return len(TYPES) + 8 + self.bytes >= 1 << 32

    def head(self) -> bytes:
        """What stands before the media data."""
        if self.wide:
            return TYPES + u32(1) + b"mdat" + (16 + self.bytes).to_bytes(8, "big")
        return TYPES + u32(8 + self.bytes) + b"mdat"

    def tail(self) -> bytes:
        """The movie box. The last sample lasts as long as the mean of the others, a single one a thirtieth of a second."""
        deltas = [*self.deltas, sum(self.deltas) // len(self.deltas) if self.deltas else MEDIA // 30]
        ticks, (w, h) = sum(deltas), self.size
        duration, full = ticks * MOVIE // MEDIA, u32(0)
        runs = [(len(list(g)), d) for d, g in groupby(deltas)]
        sps, pps = self.sets[True], self.sets[False]
        config = box(b"avcC", b"\1", sps[1:4], b"\xff\xe1", u16(len(sps)), sps, b"\1", u16(len(pps)), pps)
        entry = box(b"avc1", bytes(6), u16(1), bytes(16), u16(w, h), u32(72 << 16, 72 << 16), bytes(4), u16(1), bytes([len(NAME)]) + NAME + bytes(31 - len(NAME)), u16(24, 65_535), config)
        first = len(self.head())
        table = box(
            b"stbl", box(b"stsd", full, u32(1), entry), box(b"stts", full, u32(len(runs)), *(u32(*r) for r in runs)), box(b"stss", full, u32(len(self.syncs), *self.syncs)),
            box(b"stsc", full, u32(1, 1, len(self.sizes), 1)), box(b"stsz", full, u32(0, len(self.sizes), *self.sizes)),
            box(b"co64", full, u32(1), first.to_bytes(8, "big")) if self.wide else box(b"stco", full, u32(1, first)),
        )
        media = box(b"minf", box(b"vmhd", u32(1), bytes(8)), box(b"dinf", box(b"dref", full, u32(1), box(b"url ", u32(1)))), table)
        track = box(b"tkhd", u32(7, 0, 0, 1, 0, duration), bytes(16), _MATRIX, u32(w << 16, h << 16))
        # A version with 64-bit times where 32 bits do not hold them.
        times = u32(0, 0, 0, MEDIA, ticks) if ticks < 1 << 32 else u32(1 << 24) + bytes(16) + u32(MEDIA) + ticks.to_bytes(8, "big")
        header = box(b"mdhd", times, u16(0x55C4, 0))
        handler = box(b"hdlr", full, u32(0), b"vide", bytes(12), b"VideoHandler\0")
        movie = box(b"mvhd", full, bytes(8), u32(MOVIE, duration, 65_536), u16(256), bytes(10), _MATRIX, bytes(24), u32(2))
        return box(b"moov", movie, box(b"trak", track, box(b"mdia", header, handler, media)))
