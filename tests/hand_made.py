"""Hierarchical data files made by hand, by the format's description."""

from __future__ import annotations

import struct
import zlib

import numpy as np

NONE = (1 << 64) - 1


class Maker:
    """Appends parts to a file with superblock 0 and gives their addresses."""

    def __init__(self) -> None:
        self.data = bytearray(96)

    def add(self, part: bytes) -> int:
        self.data += bytes(-len(self.data) % 8)
        at = len(self.data)
        self.data += part
        return at

    def header(self, *messages: tuple[int, bytes], split: int | None = None) -> int:
        def packed(ms):
            return b"".join(struct.pack("<HHB3x", k, len(m) + (-len(m) % 8), 0) + m + bytes(-len(m) % 8) for k, m in ms)

        first, rest = (messages, ()) if split is None else (messages[:split], messages[split:])
        body = packed(first)
        if rest:
            more = packed(rest)
            body += packed([(0x10, struct.pack("<QQ", self.add(more), len(more)))])
        return self.add(struct.pack("<BxHII4x", 1, len(messages) + bool(rest), 1, len(body)) + body)

    def group(self, members: dict[str, int], per_node: int = 8, **how) -> int:
        names = sorted(members)
        text, places = bytearray(8), {}
        for n in names:
            places[n] = len(text)
            text += n.encode() + b"\0"
            text += bytes(-len(text) % 8)
        heap = self.add(b"HEAP" + struct.pack("<B3xQQQ", 0, len(text), NONE, self.add(bytes(text))))
        nodes = []
        for k in range(0, len(names), per_node):
            own = names[k : k + per_node]
            nodes.append(self.add(b"SNOD" + struct.pack("<BxH", 1, len(own)) + b"".join(struct.pack("<QQII16x", places[n], members[n], 0, 0) for n in own)))
        leaf = [self.tree(0, 0, [(struct.pack("<Q", 0), a) for a in nodes[k : k + 2]], struct.pack("<Q", 0)) for k in range(0, len(nodes), 2)] or [self.tree(0, 0, [], struct.pack("<Q", 0))]
        top = leaf[0] if len(leaf) == 1 else self.tree(0, 1, [(struct.pack("<Q", 0), a) for a in leaf], struct.pack("<Q", 0))
        return self.header((0x11, struct.pack("<QQ", top, heap)), **how)

    def tree(self, kind: int, level: int, entries: list[tuple[bytes, int]], last: bytes) -> int:
        return self.add(b"TREE" + struct.pack("<BBHQQ", kind, level, len(entries), NONE, NONE) + b"".join(k + struct.pack("<Q", a) for k, a in entries) + last)

    def links(self, members: dict[str, int]) -> int:
        """A group by link messages in a header of version 2."""
        info = (0x02, struct.pack("<BBQQ", 0, 0, NONE, NONE))
        messages = [info] + [(0x06, struct.pack("<BBB", 1, 0, len(n)) + n.encode() + struct.pack("<Q", a)) for n, a in members.items()]
        body = b"".join(struct.pack("<BHB", k, len(m), 0) + m for k, m in messages)
        return self.add(b"OHDR" + struct.pack("<BBI", 2, 2, len(body)) + body + bytes(4))

    def dataset(self, values: np.ndarray, chunk: tuple[int, ...] | None = None, filters: tuple[int, ...] = (), compact: bool = False, **how) -> int:
        kind = {"f": b"\x11\x20\x3f\x00", "i": b"\x10\x08\x00\x00", "u": b"\x10\x00\x00\x00", "S": b"\x13\x00\x00\x00"}[values.dtype.kind]
        messages = [(0x01, struct.pack("<BBB5x", 1, values.ndim, 0) + struct.pack(f"<{values.ndim}Q", *values.shape)), (0x03, kind + struct.pack("<I", values.itemsize) + bytes(8))]
        if chunk:
            entries = []
            for at in np.ndindex(*(-(-n // c) for n, c in zip(values.shape, chunk, strict=True))):
                first = tuple(a * c for a, c in zip(at, chunk, strict=True))
                block = np.zeros(chunk, values.dtype)
                part = values[tuple(slice(a, a + c) for a, c in zip(first, chunk, strict=True))]
                block[tuple(slice(0, n) for n in part.shape)] = part
                data = block.tobytes()
                for f in filters:
                    data = np.frombuffer(data, np.uint8).reshape(-1, values.itemsize).T.tobytes() if f == 2 else zlib.compress(data) if f == 1 else data + b"sum4"
                entries.append((struct.pack(f"<II{values.ndim + 1}Q", len(data), 0, *first, 0), self.add(data)))
            tree = self.tree(1, 0, entries, bytes(8 + 8 * (values.ndim + 1)))
            messages.append((0x08, struct.pack("<BBBQ", 3, 2, values.ndim + 1, tree) + struct.pack(f"<{values.ndim + 1}I", *chunk, values.itemsize)))
            if filters:
                messages.append((0x0B, struct.pack("<BB6x", 1, len(filters)) + b"".join(struct.pack("<HHHHI4x", f, 0, 1, 1, 0) for f in filters)))
        elif compact:
            messages.append((0x08, struct.pack("<BBH", 3, 0, values.nbytes) + values.tobytes()))
        else:
            messages.append((0x08, struct.pack("<BBQQ", 3, 1, self.add(values.tobytes()) if values.size else NONE, values.nbytes)))
        return self.header(*messages, **how)

    def strings(self, values: list[bytes]) -> int:
        """A dataset of strings of varying length."""
        objects = b"".join(struct.pack("<HH4xQ", k + 1, 1, len(v)) + v + bytes(-len(v) % 8) for k, v in enumerate(values))
        heap = self.add(b"GCOL" + struct.pack("<B3xQ", 1, 16 + len(objects) + 16) + objects + bytes(16))
        raw = b"".join(struct.pack("<IQI", len(v), heap, k + 1) for k, v in enumerate(values))
        kind = b"\x19\x01\x00\x00" + struct.pack("<I", 16) + b"\x13\x00\x00\x00" + struct.pack("<I", 1)
        return self.header((0x01, struct.pack("<BBB5xQQ", 1, 2, 0, len(values), 1)), (0x03, kind), (0x08, struct.pack("<BBQQ", 3, 1, self.add(raw), len(raw))))

    def save(self, path: str, root: int) -> str:
        self.data[:96] = b"\x89HDF\r\n\x1a\n" + struct.pack("<BBBxBBBxHHI", 0, 0, 0, 0, 8, 8, 4, 16, 0) + struct.pack("<QQQQ", 0, NONE, len(self.data), NONE) + struct.pack("<QQII16x", 0, root, 0, 0)
        with open(path, "wb") as out:
            out.write(self.data)
        return path

    def save_new(self, path: str, root: int) -> str:
        """With superblock 2."""
        self.data[:48] = b"\x89HDF\r\n\x1a\n" + struct.pack("<BBBBQQQQI", 2, 8, 8, 0, 0, NONE, len(self.data), root, 0)
        with open(path, "wb") as out:
            out.write(self.data)
        return path
