"""Registry hive images as tables.

An image is pointer-linked and must be taken apart as a whole: one file is one
row of Spark's binaryFile source and one unit of work; many hives run in
parallel. The tables that come out are relational from there on.

Tables: hives, hbins, cells, keys, values, refs, errors (see SCHEMAS).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..schema import REG_TYPES

SCHEMAS = {
    "hives": "hive_id string, primary_seq long, secondary_seq long, last_write_ft long, major int, minor int, type int, root_cell long, data_size long, cluster long, file_size long, checksum_stored long, checksum_calc long",
    "hbins": "hive_id string, abs_off long, file_off_field long, size long",
    "cells": "hive_id string, off long, hbin_off long, size long, allocated boolean, sig string",
    "keys": "hive_id string, key_off long, parent_off long, path string, path_norm string, parent_path string, name string, depth int, subkey_n long, value_n long, last_write_ft long, flags int, name_compressed boolean, class_name string, security_off long",
    "values": "hive_id string, value_off long, key_off long, key_path string, name string, list_pos int, reg_type long, type_name string, size long, inline boolean, name_compressed boolean, data binary",
    "refs": "hive_id string, kind string, src long, dst long",
    "security": "hive_id string, off long, flink long, blink long, ref_count long, size long, descriptor binary",
    "errors": "hive_id string, off long, issue string",
}
NONE = 0xFFFFFFFF
# Fixed values of the format.
HEADER_SIZE, PAGE, BIN_HEADER, CHUNK = 4096, 4096, 32, 16344
COMPRESSED_KEY, ROOT_KEY, COMPRESSED_VALUE, INLINE = 0x20, 0x04, 0x01, 0x80000000
#: Fields that repairs write: the signature of their record and their place after it begins.
RECORD_FIELDS = {"subkey_count": (b"nk", 20), "subkey_list": (b"nk", 28), "value_count": (b"nk", 36), "value_list": (b"nk", 40), "value_size": (b"vk", 4)}
# Counts and sizes that are not believed: counts only of images that are too small for the records of so many.
MOST_SUBKEYS, MOST_VALUES, MOST_DATA = 1_000_000, 1_000_000, 256 << 20
LEAST_KEY, LEAST_VALUE = 80, 24
#: Rows that an image's tables hold before they are given away; a KB of values' data counts as one more.
HELD = 10_000


class HiveError(ValueError):
    pass


def checksum(head: bytes) -> int:
    x = 0
    for (v,) in struct.iter_unpack("<I", head[:508]):
        x ^= v
    return 1 if x == 0 else NONE - 1 if x == NONE else x


def _name(raw: bytes, compressed: bool) -> str:
    if compressed:
        if raw.isascii():
            return raw.decode("ascii")
        return "".join(chr(b) if 0x80 <= b < 0xA0 and b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode("cp1252") for b in raw)
    return raw.decode("utf-16-le", "replace")


@dataclass
class Image:
    """One image, taken apart. tolerant: what can't be read becomes a row of errors; otherwise it raises."""

    hive_id: str
    data: bytes | bytearray | memoryview
    tolerant: bool = True
    max_cell: int = 64 << 20
    tables: dict[str, list[tuple]] = field(default_factory=lambda: {k: [] for k in SCHEMAS})
    held: int = 0

    def add(self, table: str, row: tuple) -> None:
        self.held += 1
        if table in self.tables:
            self.tables[table].append(row)

    def fail(self, off: int, issue: str) -> None:
        if not self.tolerant:
            raise HiveError(f"{self.hive_id}: {issue} at {off:#x}")
        self.add("errors", (self.hive_id, off, issue))

    def parse(self) -> dict[str, list[tuple]]:
        for _ in self.steps():
            pass
        return self.tables

    def pieces(self) -> Iterator[tuple[str, list[tuple]]]:
        """All tables as pieces of bounded size: name and rows."""
        for _ in self.steps():
            if self.held >= HELD:
                yield from self._taken()
        yield from self._taken()

    def _taken(self) -> Iterator[tuple[str, list[tuple]]]:
        self.held = 0
        for name, rows in self.tables.items():
            if rows:
                self.tables[name] = []
                yield name, rows

    def steps(self) -> Iterator[None]:
        """Fills the tables; between two steps few rows are added, and those that are there may be taken away."""
        d = self.data
        if len(d) < HEADER_SIZE or d[:4] != b"regf":
            self.fail(0, "no REGF header")
            return
        seq1, seq2, when, major, minor, kind, _, root, size, cluster = struct.unpack_from("<IIQIIIIIII", d, 4)
        self.add("hives", (self.hive_id, seq1, seq2, _long(when), major, minor, kind, root, size, cluster, len(d), struct.unpack_from("<I", d, 508)[0], checksum(d)))
        yield from self.bins(size)
        try:
            yield from self.walk(root)
        except (struct.error, HiveError) as e:
            if not self.tolerant:
                raise
            self.fail(root, str(e))

    def bins(self, size: int) -> Iterator[None]:
        at, end = HEADER_SIZE, min(len(self.data), HEADER_SIZE + size)
        while at + BIN_HEADER <= end:
            if self.data[at : at + 4] != b"hbin":
                self.fail(at, "no HBIN signature")
                return
            off, n = struct.unpack_from("<II", self.data, at + 4)
            self.add("hbins", (self.hive_id, at, off, n))
            if n < PAGE or n % PAGE:
                self.fail(at, "HBIN size")
                return
            cell, stop = at + BIN_HEADER, min(at + n, end)
            while cell + 4 <= stop:
                (s,) = struct.unpack_from("<i", self.data, cell)
                if s == 0 or abs(s) < 4 or cell + abs(s) > len(self.data):
                    self.add("cells", (self.hive_id, cell - HEADER_SIZE, at, abs(s), s < 0, ""))
                    self.fail(cell, "cell size")
                    break
                sig = bytes(self.data[cell + 4 : cell + 6])
                self.add("cells", (self.hive_id, cell - HEADER_SIZE, at, abs(s), s < 0, sig.decode("latin-1") if sig in _SIGNATURES and s < 0 else ""))
                cell += abs(s)
                if self.held >= HELD:
                    yield
            at += n
            yield

    def cell(self, off: int) -> bytes:
        at = HEADER_SIZE + off
        if off >= NONE or at + 4 > len(self.data):
            raise HiveError(f"offset {off:#x} is outside")
        (s,) = struct.unpack_from("<i", self.data, at)
        if s >= 0:
            raise HiveError(f"cell {off:#x} is free")
        if -s > self.max_cell or at - s > len(self.data):
            raise HiveError(f"cell {off:#x} is too large")
        return bytes(self.data[at + 4 : at - s])

    def children(self, off: int, key: int, level: int = 0) -> list[tuple[int, int, int]]:
        """Place, count and step of the lists of a key's children."""
        c = self.cell(off)
        sig, (n,) = c[:2], struct.unpack_from("<H", c, 2)
        self.add("refs", (self.hive_id, "list", key, off))
        if sig in (b"lf", b"lh"):
            if 8 * n > len(c):
                struct.unpack_from("<I", c, 4 + 8 * (len(c) // 8))  # raises
            return [(HEADER_SIZE + off + 8, n, 8)]
        if sig == b"li":
            struct.unpack_from(f"<{n}I", c, 4)
            return [(HEADER_SIZE + off + 8, n, 4)]
        if sig == b"ri" and level == 0:
            out = []
            for x in struct.unpack_from(f"<{n}I", c, 4):
                out += self.children(x, key, 1)
            return out
        raise HiveError(f"subkey list {off:#x} has signature {sig!r}")

    def content(self, off: int, size: int, vk: int) -> bytes:
        self.add("refs", (self.hive_id, "data", vk, off))
        c = self.cell(off)
        if size <= CHUNK or c[:2] != b"db":
            if len(c) < size and not self.tolerant:
                raise HiveError(f"data {off:#x} is short")
            return c[:size]
        n, blocks = struct.unpack_from("<HI", c, 2)
        self.add("refs", (self.hive_id, "blocks", off, blocks))
        out = []
        for b in struct.unpack_from(f"<{n}I", self.cell(blocks)):
            self.add("refs", (self.hive_id, "block", blocks, b))
            out.append(self.cell(b)[:CHUNK])
        return b"".join(out)[:size]

    def offsets(self, lists: list[tuple[int, int, int]]) -> Iterator[int]:
        for at, n, step in lists:
            for i in range(at, at + n * step, step):
                yield _U32.unpack_from(self.data, i)[0]

    def walk(self, root: int) -> Iterator[None]:
        # children that are to come, their parent, its path and depth; a bit for each offset of the image that was met
        stack, secured = [(iter((root,)), None, "", -1)], set()
        seen, far = bytearray(len(self.data) // 8 + 1), set()
        while stack:
            yield
            kids, parent, above, depth = stack[-1]
            off = next(kids, None)
            if off is None:
                stack.pop()
                continue
            if parent is not None:
                self.add("refs", (self.hive_id, "key", parent, off))
            inside = off < len(self.data)
            if (seen[off >> 3] >> (off & 7)) & 1 if inside else off in far:
                self.fail(off, "key is reached again")
                continue
            if inside:
                seen[off >> 3] |= 1 << (off & 7)
            else:
                far.add(off)
            try:
                c = self.cell(off)
                if c[:2] != b"nk" or len(c) < 76:
                    raise HiveError(f"no key at {off:#x}")
                flags, when = struct.unpack_from("<HQ", c, 2)
                _, n, _, subs, _, vn, vals, sk, cls = struct.unpack_from("<9I", c, 16)
                nl, cl = struct.unpack_from("<HH", c, 72)
                short = bool(flags & COMPRESSED_KEY)
                name = _name(c[76 : 76 + nl], short)
                path = "" if depth < 0 else f"{above}\\{name}" if above else name
            except (HiveError, struct.error) as e:
                self.fail(off, str(e))
                continue
            class_name = None
            if cls != NONE and cl:
                try:
                    class_name = _name(self.cell(cls)[:cl], False)
                except (HiveError, struct.error) as e:
                    self.fail(off, f"class name: {e}")
            if sk != NONE and sk not in secured:
                secured.add(sk)
                self.security(sk)
            for kind, x in (("security", sk), ("class", cls)):
                if x != NONE:
                    self.add("refs", (self.hive_id, kind, off, x))
            self.add("keys", (self.hive_id, off, parent, path, path.lower(), above if depth >= 0 else None, name, depth + 1, n, vn, _long(when), flags, short, class_name, sk))
            if vn:
                yield from self.values(off, path, vn, vals)
            if not n:
                continue
            try:
                if n > max(MOST_SUBKEYS, len(self.data) // LEAST_KEY):
                    raise HiveError(f"{n} subkeys")
                lists = self.children(subs, off)
            except (HiveError, struct.error) as e:
                self.fail(off, str(e))
                continue
            stack.append((self.offsets(lists), off, path, depth + 1))

    def security(self, off: int) -> None:
        try:
            c = self.cell(off)
            if c[:2] != b"sk":
                raise HiveError(f"no security record at {off:#x}")
            _, flink, blink, count, size = struct.unpack_from("<HIIII", c, 2)
            self.add("security", (self.hive_id, off, flink, blink, count, size, c[20 : 20 + size]))
        except (HiveError, struct.error) as e:
            self.fail(off, str(e))

    def values(self, key: int, path: str, n: int, off: int) -> Iterator[None]:
        try:
            if n > max(MOST_VALUES, len(self.data) // LEAST_VALUE):
                raise HiveError(f"{n} values")
            offs = memoryview(self.cell(off))
            if 4 * n > len(offs):
                struct.unpack_from(f"<{n}I", offs)  # raises
            offs = offs[: 4 * n].cast("I")
            self.add("refs", (self.hive_id, "values", key, off))
        except (HiveError, struct.error) as e:
            self.fail(key, str(e))
            return
        for i, v in enumerate(offs):
            yield
            self.add("refs", (self.hive_id, "value", key, v))
            try:
                c = self.cell(v)
                if c[:2] != b"vk":
                    raise HiveError(f"no value at {v:#x}")
                nl, size, at, kind, flags = struct.unpack_from("<HIIIH", c, 2)
                inline, size = bool(size & INLINE), size & ~INLINE
                if size > MOST_DATA:
                    raise HiveError(f"{size} bytes of data")
                data = struct.pack("<I", at)[: min(size, 4)] if inline else self.content(at, size, v) if size else b""
            except (HiveError, struct.error) as e:
                self.fail(v, str(e))
                continue
            short = bool(flags & COMPRESSED_VALUE)
            signed = kind - (1 << 32) if kind >= 1 << 31 else kind
            self.add("values", (self.hive_id, v, key, path, _name(c[20 : 20 + nl], short), i, kind, REG_TYPES.get(kind, f"UNKNOWN_TYPE_{signed}"), size, inline, short, data))
            self.held += len(data) >> 10


_U32 = struct.Struct("<I")
_SIGNATURES = {b"nk", b"vk", b"sk", b"lf", b"lh", b"li", b"ri", b"db"}


def _long(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def contents(batch: pa.RecordBatch) -> Iterator[tuple[str, memoryview]]:
    """Id and image of each row, the images where they are."""
    for hive, content in zip(batch.column(0), batch.column(1), strict=True):
        yield hive.as_py(), memoryview(content.as_buffer()).cast("B") if content.is_valid else memoryview(b"")


def image_batch(names: list[str], hive: str | None, data: bytes | bytearray | memoryview, *more: pa.Array) -> pa.RecordBatch:
    """One row of an image, which is not copied."""
    place = pa.py_buffer(struct.pack("<ii", 0, len(data)))
    return pa.RecordBatch.from_arrays([pa.array([hive], pa.string()), pa.Array.from_buffers(pa.binary(), 1, [None, place, pa.py_buffer(data)]), *more], names)


def take_apart(files: DataFrame, table: str, tolerant: bool = True, id_col: str = "path", content_col: str = "content", max_cell: int = 64 << 20) -> DataFrame:
    """One table of all images in `files`."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(SCHEMAS[table]))

    def run(batches):
        for b in batches:
            for hive, content in contents(b):
                for _, rows in Image(hive, content, tolerant, max_cell, {table: []}).pieces():
                    cols = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, schema, strict=True)], schema=schema)

    return files.select(id_col, content_col).mapInArrow(run, SCHEMAS[table])


def tables(files: DataFrame, tolerant: bool = True, id_col: str = "path", content_col: str = "content", max_cell: int = 64 << 20) -> dict[str, DataFrame]:
    """All tables of all images, each image taken apart once: rows are tagged with their table and kept on disk until unpersisted."""
    from pyspark import StorageLevel
    from pyspark.sql import functions as F
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = "kind string, " + ", ".join(f"{name} struct<{', '.join(x.replace(' ', ': ') for x in fields.split(', '))}>" for name, fields in SCHEMAS.items())
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches):
        for b in batches:
            for hive, content in contents(b):
                for name, rows in Image(hive, content, tolerant, max_cell).pieces():
                    kind, n = schema.field(name).type, len(rows)
                    struct_ = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), kind, strict=True)], fields=list(kind))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), *(struct_ if f.name == name else pa.nulls(n, f.type) for f in list(schema)[1:])], schema=schema)

    tagged = files.select(id_col, content_col).mapInArrow(run, ddl).persist(StorageLevel.DISK_ONLY)
    return {name: tagged.where(F.col("kind") == name).select(f"{name}.*") for name in SCHEMAS}


def read(spark: SparkSession, path: str, table: str = "keys", **how) -> DataFrame:
    """One table of all images under a path that any of Spark's file systems can read."""
    return take_apart(spark.read.format("binaryFile").load(path).select("path", "content"), table, **how)
