"""`.reg` text as change logs, and change logs or trees as `.reg` text.

Parsing needs a file's whole state (the section, continued lines), so each
file is parsed by itself, many files in parallel; everything after is columns.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cols as c
from ..schema import CREATE, DELETE_KEY, DELETE_VALUE, SET

HEADER = "Windows Registry Editor Version 5.00"
OLD_HEADER = "REGEDIT4"
_VALUE = re.compile(r'\s*(@|"(?:[^"\\]|\\.)*")\s*=\s*(.*)', re.S)
_HEX = re.compile(r"hex(?:\(([0-9a-fA-F]+)\))?:(.*)", re.S | re.I)


class RegTextError(ValueError):
    pass


def decode(data: bytes) -> str:
    """UTF-8 or UTF-16LE, by the mark in front or by NUL bytes."""
    if data[:2] == b"\xff\xfe":
        return data[2:].decode("utf-16-le")
    if data[:3] == b"\xef\xbb\xbf":
        return data[3:].decode("utf-8")
    if len(data) >= 2 and data[1] == 0 and data[0] != 0:
        return data.decode("utf-16-le")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace")


def _unescape(s: str) -> str:
    return re.sub(r'\\([\\"])', r"\1", s)


def _logical_lines(text: str):
    """Lines with continued ones joined, and the number of the first."""
    held, first = "", 0
    for n, line in enumerate(text.splitlines(), 1):
        if not held:
            first = n
        line = held + line.strip() if held else line.strip()
        value = _VALUE.match(line)
        if line.endswith("\\") and value and _HEX.match(value[2]):
            held = line[:-1]
            continue
        held = ""
        yield first, line
    if held:
        yield first, held


def _value(text: str) -> tuple[int, bytes] | None:
    """Type and data; None is a delete."""
    text = text.strip()
    if text == "-":
        return None
    if text.startswith('"'):
        m = re.match(r'"((?:[^"\\]|\\.)*)"', text, re.S)
        if not m:
            raise RegTextError("string without an end")
        return 1, (_unescape(m[1]) + "\0").encode("utf-16-le")
    if text.lower().startswith("dword:"):
        digits = text[6:].strip()
        if not re.fullmatch("[0-9a-fA-F]{8}", digits):
            raise RegTextError("a dword has eight hex digits")
        return 4, int(digits, 16).to_bytes(4, "little")
    if m := _HEX.match(text):
        kind = 3 if m[1] is None else 11 if m[1].lower() in ("b", "11") else int(m[1], 16)
        parts = [p.strip() for p in re.sub(r"[\s\\]", "", m[2]).split(",")]
        try:
            data = bytes(int(p, 16) for p in parts if p)
        except ValueError as e:
            raise RegTextError("not hex bytes") from e
        return (kind if kind in (0, 1, 2, 3, 4, 5, 6, 7, 11) else 3), data
    raise RegTextError(f"unknown value {text[:40]!r}")


def parse(text: str, missing_header: bool = True, lenient: bool = False):
    """(op, path, name, type, data) in order. lenient: values that can't be read are skipped."""
    section, seen, started = None, set(), False
    for n, line in _logical_lines(text):
        if not line or line.startswith(";"):
            continue
        if not started:
            started = True
            if line in (HEADER, OLD_HEADER):
                continue
            if not missing_header:
                raise RegTextError("no header")
        if line.startswith("["):
            end = line.rfind("]")
            if end < 0:
                raise RegTextError(f"line {n}: section without an end")
            path = line[1:end]
            if path.startswith("-"):
                path = path[1:].strip()
                seen = {p for p in seen if p != path.lower() and not p.startswith(path.lower() + "\\")}
                section = None
                yield DELETE_KEY, path, None, None, None
                continue
            section = path
            if path.lower() not in seen:  # the first section of a key creates it
                seen.add(path.lower())
                yield CREATE, path, None, None, None
            continue
        m = _VALUE.match(line)
        if not m:
            if lenient:
                continue
            raise RegTextError(f"line {n}: {line[:60]!r}")
        if section is None:
            if lenient:
                continue
            raise RegTextError(f"line {n}: value outside a section")
        name = "" if m[1] == "@" else _unescape(m[1][1:-1])
        try:
            got = _value(m[2])
        except RegTextError:
            if lenient:
                continue
            raise
        if got is None:
            yield DELETE_VALUE, section, name, None, None
        else:
            yield SET, section, name, *got


_SCHEMA = "file string, line long, op string, raw_path string, name string, reg_type int, data binary"


def parse_files(files: DataFrame, file_col: str = "path", content_col: str = "content", **how) -> DataFrame:
    """files: a name and bytes (or text) of each. Operations with file and line (their order in it), path and path_norm."""

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = content if isinstance(content, str) else decode(content or b"")
                rows = [(name, i, *op) for i, op in enumerate(parse(text, **how), 1)]
                if rows:
                    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "line", "op", "raw_path", "name", "reg_type", "data"])

    out = files.select(file_col, content_col).mapInArrow(run, _SCHEMA)
    return out.withColumn("path", c.clean_path("raw_path")).withColumn("path_norm", F.lower("path"))


def read(spark: SparkSession, *paths: str, **how) -> DataFrame:
    """Operations of files, in the order of `paths`: seq is (place of the path, file, line)."""
    out = None
    for i, p in enumerate(paths):
        files = spark.read.format("binaryFile").load(p).select("path", "content")
        ops = parse_files(files, **how).withColumn("file_idx", F.lit(i)).withColumn("seq", F.struct("file_idx", "file", "line"))
        out = ops if out is None else out.unionByName(ops)
    return out.select("seq", "file_idx", "op", "path", "path_norm", "name", "reg_type", "data")


def value_text(reg_type: Column | str, data: Column | str) -> Column:
    """The right side of a value's line."""
    r = F.col(reg_type) if isinstance(reg_type, str) else reg_type
    d = F.col(data) if isinstance(data, str) else data
    text = c.utf16(d)
    plain = F.concat(F.lit('"'), c.reg_escape(text), F.lit('"'))
    whole = (r == 1) & text.isNotNull() & ~F.coalesce(text.rlike("[\r\n\\x00]"), F.lit(True)) & (c.sz_bytes(text) == d)
    number = F.concat(F.lit("dword:"), F.lower(F.lpad(F.hex(c.dword(d)), 8, "0")))
    tag = F.when(r == 3, "hex:").otherwise(F.concat(F.lit("hex("), F.lower(F.hex(r.cast("long"))), F.lit("):")))
    return F.when(whole, plain).when((r == 4) & (F.octet_length(d) == 4), number).otherwise(F.concat(tag, c.hex_list(d)))


def name_text(name: Column | str) -> Column:
    n = F.col(name) if isinstance(name, str) else name
    return F.when(n == "", "@").otherwise(F.concat(F.lit('"'), c.reg_escape(n), F.lit('"')))


def lines(keys: DataFrame, values: DataFrame, root: str = "") -> DataFrame:
    """Lines of a `.reg` file; sort by (preorder, kind, name) to write. keys: path; values: key_path, name, reg_type, data."""
    full = lambda p: F.concat(F.lit(root + c.SEP if root else ""), p)
    order = lambda p: F.split(F.lower(p), r"\\")
    k = keys.select(order(F.col("path")).alias("preorder"), F.lit(0).alias("kind"), F.lit("").alias("name"), F.concat(F.lit("["), full(F.col("path")), F.lit("]")).alias("line"))
    text = F.concat(name_text("name"), F.lit("="), value_text("reg_type", "data"))
    v = values.select(order(F.col("key_path")).alias("preorder"), F.lit(1).alias("kind"), "name", text.alias("line"))
    return k.unionByName(v)


def write(keys: DataFrame, values: DataFrame, path: str, root: str = "") -> None:
    """A folder with the lines in order: range-partitioned parts, their names in order; the header is the first part's first line."""
    body = lines(keys, values, root)
    head = keys.sparkSession.range(1).select(F.array().cast("array<string>").alias("preorder"), F.lit(-1).alias("kind"), F.lit("").alias("name"), F.lit(HEADER + "\r\n").alias("line"))
    body.withColumn("line", F.when(F.col("kind") == 0, F.concat(F.lit("\r\n"), "line")).otherwise(F.col("line"))).unionByName(head).orderBy("preorder", "kind", "name").select("line").write.option("lineSep", "\r\n").text(path)
