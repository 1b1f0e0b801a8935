"""Registry hive images from keys and values, one image for each group of rows.

Rows come in the order of a walk, so an image is written once from front to back:
what is held beside it are the offsets below the keys of the current path.
"""

from __future__ import annotations

import struct
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cols import SEP
from .regf import BIN_HEADER, CHUNK, COMPRESSED_KEY, COMPRESSED_VALUE, HEADER_SIZE, INLINE, NONE, PAGE, ROOT_KEY, HiveError, checksum, image_batch

# Entries of a subkey list up to which it is of kind lf, and of kind lh; above, lists of lists.
MOST_LF, MOST_LH = 12, 1024
#: A descriptor without owner, group or lists.
_DESCRIPTOR = struct.pack("<BBHIIII", 1, 0, 0x8000, 0, 0, 0, 0)


def lh_hash(name: str) -> int:
    h = 0
    for unit in struct.unpack(f"<{len(name.upper().encode('utf-16-le')) // 2}H", name.upper().encode("utf-16-le")):
        h = (h * 37 + unit) & NONE
    return h


def _encoded(name: str) -> tuple[bytes, bool]:
    try:
        return name.encode("latin-1" if all(ord(x) < 0x80 or 0xA0 <= ord(x) < 0x100 for x in name) else "cp1252"), True
    except UnicodeEncodeError:
        return name.encode("utf-16-le"), False


class _Key:
    """A key of the current path: its offset, and those of what is below it."""

    __slots__ = ("data_max", "hashes", "hints", "kids", "name_max", "norm", "off", "value_name_max", "values")

    def __init__(self, norm: str, off: int) -> None:
        self.norm, self.off = norm, off
        self.name_max = self.value_name_max = self.data_max = 0
        self.kids = self.hashes = self.hints = self.values = None


class _Image:
    """An image that grows by keys in the order of a walk, each with its values before those below it."""

    def __init__(self, root: str = "ROOT", last_write_ft: int = 0) -> None:
        self.data = bytearray(HEADER_SIZE)
        self.bin_end = HEADER_SIZE
        self.last_write_ft, self.n = last_write_ft, 0
        self.sk = NONE
        self.open: list[_Key] = []
        self._push("", root)
        self.sk = self._add(struct.pack("<2sHIIII", b"sk", 0, 0, 0, 0, len(_DESCRIPTOR)) + _DESCRIPTOR)
        self._patch(self.sk, 4, self.sk)
        self._patch(self.sk, 8, self.sk)
        self._patch(self.open[0].off, 44, self.sk)

    def _add(self, body: bytes) -> int:
        data, size = self.data, (len(body) + 4 + 7) // 8 * 8
        if len(data) + size > self.bin_end:
            self._end_bin()
            total = -(-(size + BIN_HEADER) // PAGE) * PAGE
            self.bin_end = len(data) + total
            data += struct.pack("<4sIIQQI", b"hbin", len(data) - HEADER_SIZE, total, 0, 0, 0)
        off = len(data) - HEADER_SIZE
        data += struct.pack("<i", -size)
        data += body
        data += bytes(size - 4 - len(body))
        return off

    def _end_bin(self) -> None:
        rest = self.bin_end - len(self.data)
        if rest:
            self.data += struct.pack("<i", rest) + bytes(rest - 4)

    def _patch(self, off: int, at: int, *numbers: int) -> None:
        struct.pack_into(f"<{len(numbers)}I", self.data, HEADER_SIZE + off + 4 + at, *numbers)

    def _push(self, norm: str, name: str) -> None:
        raw, short = _encoded(name)
        above = self.open[-1] if self.open else None
        flags = (COMPRESSED_KEY if short else 0) | (0 if above else ROOT_KEY | 0x08)
        off = self._add(struct.pack("<2sHq14IIHH", b"nk", flags, self.last_write_ft, 0, above.off if above else NONE, 0, 0, NONE, NONE, 0, NONE, self.sk, NONE, 0, 0, 0, 0, 0, len(raw), 0) + raw)
        if above:
            if above.kids is None:
                above.kids, above.hashes, above.hints = array("I"), array("I"), []
            above.kids.append(off)
            above.hashes.append(lh_hash(name))
            if len(above.hints) < MOST_LF:
                above.hints.append(name.encode("latin-1", "replace")[:4].ljust(4, b"\0"))
            above.name_max = max(above.name_max, len(name) * 2)
        self.open.append(_Key(norm, off))
        self.n += 1

    def _pop(self) -> None:
        key = self.open.pop()
        if key.kids:
            n = len(key.kids)
            if n <= MOST_LF:
                lists = [self._add(struct.pack("<2sH", b"lf", n) + b"".join(struct.pack("<I", o) + h for o, h in zip(key.kids, key.hints, strict=True)))]
            else:
                lists = []
                for i in range(0, n, MOST_LH):
                    both = [x for pair in zip(key.kids[i : i + MOST_LH], key.hashes[i : i + MOST_LH], strict=True) for x in pair]
                    lists.append(self._add(struct.pack(f"<2sH{len(both)}I", b"lh", len(both) // 2, *both)))
            top = lists[0] if len(lists) == 1 else self._add(struct.pack(f"<2sH{len(lists)}I", b"ri", len(lists), *lists))
            self._patch(key.off, 20, n)
            self._patch(key.off, 28, top)
            self._patch(key.off, 52, key.name_max)
        if key.values:
            self._patch(key.off, 36, len(key.values), self._add(struct.pack(f"<{len(key.values)}I", *key.values)))
            self._patch(key.off, 60, key.value_name_max * 2, key.data_max)

    def key(self, norm: list[str], names: list[str], last_write_ft: int | None = None) -> None:
        """The next key in the order of `norm`, the same one again, or one below; missing keys above it are made."""
        k, known = 0, self.open
        while k < len(norm) and k + 1 < len(known) and known[k + 1].norm == norm[k]:
            k += 1
        while len(known) > k + 1:
            self._pop()
        for i in range(k, len(norm)):
            self._push(norm[i], names[i])
        if last_write_ft is not None:
            struct.pack_into("<q", self.data, HEADER_SIZE + known[-1].off + 8, last_write_ft)

    def value(self, name: str, kind: int | None, data: bytes | None) -> None:
        """A value of the last key."""
        raw, short = _encoded(name)
        key, data = self.open[-1], data or b""
        if len(data) <= 4:
            size, at = len(data) | INLINE, struct.unpack("<I", data.ljust(4, b"\0"))[0]
        elif len(data) <= CHUNK:
            size, at = len(data), self._add(data)
        else:
            chunks = [self._add(data[i : i + CHUNK]) for i in range(0, len(data), CHUNK)]
            blocks = self._add(struct.pack(f"<{len(chunks)}I", *chunks))
            size, at = len(data), self._add(struct.pack("<2sHII", b"db", len(chunks), blocks, 0))
        if key.values is None:
            key.values = array("I")
        key.values.append(self._add(struct.pack("<2sHIIIHH", b"vk", len(raw), size, at, (kind or 0) & NONE, COMPRESSED_VALUE if short else 0, 0) + raw))
        key.value_name_max, key.data_max = max(key.value_name_max, len(raw)), max(key.data_max, len(data))

    def finish(self) -> bytearray:
        root = self.open[0].off
        while self.open:
            self._pop()
        self._patch(self.sk, 12, self.n)
        self._end_bin()
        if len(self.data) >= 1 << 31:
            raise HiveError(f"an image of {len(self.data)} bytes")
        struct.pack_into("<4sIIqIIIIIII", self.data, 0, b"regf", 1, 1, self.last_write_ft, 1, 5, 0, 1, root, len(self.data) - HEADER_SIZE, 1)
        struct.pack_into("<I", self.data, 508, checksum(bytes(self.data[:HEADER_SIZE])))
        return self.data


def _parts(path: str, sep: str = SEP) -> list[str]:
    return path.removeprefix(sep).split(sep) if path.removeprefix(sep) else []


def build(keys: list[dict], values: list[dict], root: str = "ROOT", last_write_ft: int = 0) -> bytes:
    """keys: path, last_write_ft; values: key_path, name, reg_type, data. Missing keys above others are made."""
    rows = [(_parts(k["path"].lower()), 0, k["path"], k) for k in keys] + [(_parts(v["key_path"].lower()), 1, v["key_path"], v) for v in values]
    image = _Image(root, last_write_ft)
    for norm, kind, path, r in sorted(rows, key=lambda x: x[:2]):
        image.key(norm, _parts(path), None if kind else r.get("last_write_ft") or last_write_ft)
        if kind:
            image.value(r["name"], r["reg_type"], r["data"])
    return bytes(image.finish())


def write(keys: DataFrame, values: DataFrame, hive_col: str = "hive_id") -> DataFrame:
    """hive_id and image of each group of keys and values. A hive is one unit of work, as its cells point to each other.

    Spark sorts the rows, on disk if need be; a value's place in its key is that of its row.
    """
    k = keys.select(hive_col, "path", F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("reg_type"), F.lit(None).cast("binary").alias("data"))
    v = values.select(hive_col, F.col("key_path").alias("path"), "name", F.col("reg_type").cast("int"), "data")
    # the separator comes before all else, so that a key is followed by those below it; names may have any character
    norm = F.lower(F.when(F.col("path").startswith(SEP), F.substring(F.col("path"), F.lit(2), F.length("path"))).otherwise(F.col("path")))
    for char, code in (("\1", "\1\2"), ("\0", "\1\1"), (SEP, "\0")):
        norm = F.replace(norm, F.lit(char), F.lit(code))

    def run(batches):
        image = hive = None
        for b in batches:
            for h, norm, path, name, kind, data in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if image is None or h != hive:
                    if image is not None:
                        yield image_batch([hive_col, "image"], hive, image.finish())
                    hive, image = h, _Image()
                image.key(norm.split("\0") if norm else [], _parts(path))
                if name is not None:
                    image.value(name, kind, data)
        if image is not None:
            yield image_batch([hive_col, "image"], hive, image.finish())

    rows = k.unionByName(v).withColumns({"_norm": norm, "_row": F.monotonically_increasing_id()}).repartition(hive_col)
    rows = rows.sortWithinPartitions(hive_col, "_norm", F.col("name").isNotNull(), "_row")
    return rows.select(hive_col, "_norm", "path", "name", "reg_type", "data").mapInArrow(run, f"{hive_col} string, image binary")
