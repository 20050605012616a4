"""Reads groups and datasets of hierarchical data files (HDF5) by ranges of bytes.

What sequence files use is covered: superblocks 0 to 3, groups as B-trees of names or as link messages, datasets stored compactly, in one piece or
in chunks, deflated and byte-shuffled ones too, of whole numbers, floats, and byte strings of fixed or varying length. Anything
else raises Unsupported with its name.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np

SIGNATURE = b"\x89HDF\r\n\x1a\n"
#: Fixed values of the format: kinds of header messages.
DATASPACE, LINK_INFO, DATATYPE, LINK, LAYOUT, FILTERS, CONTINUED, SYMBOLS = 0x01, 0x02, 0x03, 0x06, 0x08, 0x0B, 0x10, 0x11
_NONE = (1 << 64) - 1


class Unsupported(ValueError):
    """A part of the format that isn't read here."""


class Container:
    """An open file; objects are named by the address of their header."""

    def __init__(self, file: BinaryIO) -> None:
        self.file = file
        head = self.at(0, 96)
        if head[:8] != SIGNATURE:
            raise ValueError("not a hierarchical data file")
        version = head[8]
        if version > 3:
            raise Unsupported(f"superblock {version}")
        self.offset, self.length = (head[13], head[14]) if version < 2 else (head[9], head[10])
        if (self.offset, self.length) != (8, 8):
            raise Unsupported(f"addresses of {self.offset} and lengths of {self.length} bytes")
        first = {0: 24, 1: 28}.get(version, 12)
        self.base = struct.unpack_from("<Q", head, first)[0]
        self.root = struct.unpack_from("<Q", head, first + (40 if version < 2 else 24))[0]
        self.heaps: dict[int, dict[int, bytes]] = {}

    def at(self, address: int, size: int) -> bytes:
        self.file.seek(address)
        return self.file.read(size)

    def _bytes(self, address: int, size: int) -> bytes:
        data = self.at(self.base + address, size)
        if len(data) < size:
            raise ValueError(f"the file ends within {size} bytes at {address}")
        return data

    def messages(self, address: int) -> list[tuple[int, bytes]]:
        """Kind and content of an object's header messages."""
        head = self._bytes(address, 16)
        found: list[tuple[int, bytes]] = []
        if head[:4] == b"OHDR":
            flags = head[5]
            at = 6 + (16 if flags & 0x20 else 0) + (4 if flags & 0x10 else 0)
            width = 1 << (flags & 3)
            size = int.from_bytes(self._bytes(address + at, width), "little")
            blocks = [(address + at + width, size)]
            while blocks:
                start, size = blocks.pop(0)
                data, k, fixed = self._bytes(start, size), 0, 6 if flags & 4 else 4
                while k + fixed <= len(data):
                    kind, n = struct.unpack_from("<BH", data, k)
                    body = data[k + fixed : k + fixed + n]
                    if kind == CONTINUED:
                        to, more = struct.unpack("<QQ", body)
                        blocks.append((to + 4, more - 8))  # between signature and checksum
                    found.append((kind, body))
                    k += fixed + n
            return found
        if head[0] != 1:
            raise Unsupported(f"object header {head[0]}")
        blocks = [(address + 16, struct.unpack_from("<I", head, 8)[0])]
        while blocks:
            start, size = blocks.pop(0)
            data, k = self._bytes(start, size), 0
            while k + 8 <= len(data):
                kind, n = struct.unpack_from("<HH", data, k)
                body = data[k + 8 : k + 8 + n]
                if kind == CONTINUED:
                    blocks.append(struct.unpack("<QQ", body[:16]))
                found.append((kind, body))
                k += 8 + n
        return found

    def _tree(self, address: int, kind: int, key: int) -> Iterator[tuple[bytes, int]]:
        """Key and address of the leaves of a B-tree."""
        head = self._bytes(address, 24)
        if head[:4] != b"TREE" or head[4] != kind:
            raise ValueError(f"no tree of kind {kind} at {address}")
        level, used = head[5], struct.unpack_from("<H", head, 6)[0]
        data = self._bytes(address + 24, used * (key + 8) + key)
        for k in range(used):
            at = k * (key + 8)
            child = struct.unpack_from("<Q", data, at + key)[0]
            if level:
                yield from self._tree(child, kind, key)
            else:
                yield data[at : at + key], child

    def members(self, address: int) -> dict[str, int] | None:
        """Names and addresses of a group's members; None if the object is no group."""
        messages = self.messages(address)
        by_kind = dict(messages)
        if SYMBOLS in by_kind:
            tree, heap = struct.unpack_from("<QQ", by_kind[SYMBOLS])
            names = self._bytes(heap, 32)
            size, data = struct.unpack_from("<Q", names, 8)[0], struct.unpack_from("<Q", names, 24)[0]
            text = self._bytes(data, size)
            found = {}
            for _, node in self._tree(tree, 0, 8):
                if self._bytes(node, 4) != b"SNOD":
                    raise ValueError(f"no names at {node}")
                count = struct.unpack_from("<H", self._bytes(node + 6, 2))[0]
                for entry in struct.iter_unpack("<QQ24x", self._bytes(node + 8, 40 * count)):
                    found[text[entry[0] : text.index(b"\0", entry[0])].decode()] = entry[1]
            return found
        if LINK_INFO not in by_kind and LINK not in by_kind:
            return None
        if LINK_INFO in by_kind:
            info = by_kind[LINK_INFO]
            if struct.unpack_from("<Q", info, 2 + (8 if info[1] & 1 else 0))[0] != _NONE:
                raise Unsupported("a group with its links in a heap")
        return dict(filter(None, (self._link(m) for k, m in messages if k == LINK)))

    @staticmethod
    def _link(message: bytes) -> tuple[str, int] | None:
        """Name and address of a hard link."""
        flags, at = message[1], 2
        kind = message[at] if flags & 8 else 0
        at += (1 if flags & 8 else 0) + (8 if flags & 4 else 0) + (1 if flags & 16 else 0)
        width = 1 << (flags & 3)
        size = int.from_bytes(message[at : at + width], "little")
        name = message[at + width : at + width + size].decode()
        return None if kind else (name, struct.unpack_from("<Q", message, at + width + size)[0])

    def find(self, name: str) -> int | None:
        """The group of that name: in the root, else the first below by names in order."""
        waiting = [self.root]
        while waiting:
            members = self.members(waiting.pop(0)) or {}
            inner = [(k, a) for k, a in sorted(members.items()) if self.members(a) is not None]
            for k, a in inner:
                if k == name:
                    return a
            waiting = [a for _, a in inner] + waiting
        return None

    def shape(self, message: bytes) -> tuple[int, ...]:
        at = 8 if message[0] == 1 else 4
        return struct.unpack_from(f"<{message[1]}Q", message, at)

    def dataset(self, address: int) -> np.ndarray:
        """The values: numbers, or an array of bytes."""
        by_kind = dict(self.messages(address))
        if not {DATASPACE, DATATYPE, LAYOUT} <= by_kind.keys():
            raise ValueError(f"no dataset at {address}")
        shape, kind = self.shape(by_kind[DATASPACE]), by_kind[DATATYPE]
        size = struct.unpack_from("<I", kind, 4)[0]
        raw = self._raw(by_kind[LAYOUT], by_kind.get(FILTERS, b""), shape, size)
        return self._values(raw, kind, size).reshape(shape)

    def _values(self, raw: bytes, kind: bytes, size: int) -> np.ndarray:
        what, order = kind[0] & 15, ">" if kind[1] & 1 else "<"
        if what == 0:
            return np.frombuffer(raw, f"{order}{'i' if kind[1] & 8 else 'u'}{size}")
        if what == 1 and size in (2, 4, 8):
            return np.frombuffer(raw, f"{order}f{size}")
        if what == 3:
            return np.array([x.rstrip(b" " if kind[1] & 15 == 2 else b"\0").split(b"\0")[0] for x in np.frombuffer(raw, f"V{size}").tolist()], object) if raw else np.zeros(0, object)
        if what == 9 and kind[1] & 15 == 1:
            return np.array([self._heap(heap).get(index, b"")[:n] if n else b"" for n, heap, index in struct.iter_unpack("<IQI", raw)], object)
        raise Unsupported(f"a datatype of class {what} and {size} bytes")

    def _heap(self, address: int) -> dict[int, bytes]:
        """Objects of a heap of strings."""
        if address not in self.heaps:
            head = self._bytes(address, 16)
            if head[:4] != b"GCOL":
                raise ValueError(f"no heap at {address}")
            data, at, found = self._bytes(address, struct.unpack_from("<Q", head, 8)[0]), 16, {}
            while at + 16 <= len(data):
                index, size = struct.unpack_from("<H", data, at)[0], struct.unpack_from("<Q", data, at + 8)[0]
                if not index:
                    break
                found[index] = data[at + 16 : at + 16 + size]
                at += 16 + -(-size // 8) * 8
            self.heaps = {address: found}  # neighbouring strings share one
        return self.heaps[address]

    def _raw(self, layout: bytes, filters: bytes, shape: tuple[int, ...], size: int) -> bytes:
        if layout[0] != 3:
            raise Unsupported(f"layout {layout[0]}")
        total = int(np.prod(shape, dtype=np.int64)) * size
        if layout[1] == 0:
            return layout[4 : 4 + struct.unpack_from("<H", layout, 2)[0]]
        address = struct.unpack_from("<Q", layout, 2 if layout[1] == 1 else 3)[0]
        if address == _NONE or not total:
            return bytes(total)
        if layout[1] == 1:
            return self._bytes(address, total)
        return self._chunks(address, struct.unpack_from(f"<{layout[2]}I", layout, 11)[:-1], self._steps(filters), shape, size)

    @staticmethod
    def _steps(filters: bytes) -> list[int]:
        """Numbers of the filters in the order they were applied."""
        if not filters:
            return []
        at, found = 8 if filters[0] == 1 else 2, []
        for _ in range(filters[1]):
            number = struct.unpack_from("<H", filters, at)[0]
            named = filters[0] == 1 or number >= 256
            name, values = (struct.unpack_from("<H", filters, at + 2)[0] if named else 0), struct.unpack_from("<H", filters, at + (6 if named else 4))[0]
            at += (8 if named else 6) + (-(-name // 8) * 8 if filters[0] == 1 else name) + 4 * values + (4 if filters[0] == 1 and values % 2 else 0)
            found.append(number)
        return found

    def _chunks(self, tree: int, chunk: tuple[int, ...], steps: list[int], shape: tuple[int, ...], size: int) -> bytes:
        out = np.zeros((*shape, size), np.uint8)
        for key, address in self._tree(tree, 1, 8 + 8 * (len(shape) + 1)):
            stored, skipped, *first = struct.unpack(f"<II{len(shape)}Q", key[:-8])
            data = self._bytes(address, stored)
            for k, number in reversed(list(enumerate(steps))):
                if skipped >> k & 1:
                    continue
                if number == 1:
                    data = zlib.decompress(data)
                elif number == 2:
                    data = np.frombuffer(data, np.uint8).reshape(size, -1).T.tobytes()
                elif number == 3:
                    data = data[:-4]
                else:
                    raise Unsupported(f"filter {number}")
            there = tuple(slice(a, min(a + n, m)) for a, n, m in zip(first, chunk, shape, strict=True))
            values = np.frombuffer(data, np.uint8).reshape(*chunk, size)
            out[there] = values[tuple(slice(0, s.stop - s.start) for s in there)]
        return out.tobytes()
