import os
import struct

import pytest
from pyspark.sql import functions as F

from regspark.operators import checks, export, repair
from regspark.schema import CREATE, DELETE_KEY, DELETE_VALUE, SET
from regspark.sources import hivewriter, regf, regtext

KEYS = [{"path": "A\\B"}, {"path": "abcd_äöüß"}, {"path": "weird™"}, {"path": "日本"}, *({"path": f"Wide\\k{i}"} for i in range(1500))]
VALUES = [
    {"key_path": "A", "name": "", "reg_type": 1, "data": "x\0".encode("utf-16-le")},
    {"key_path": "A\\B", "name": "big", "reg_type": 3, "data": os.urandom(40_000)},
    {"key_path": "A\\B", "name": "edge", "reg_type": 3, "data": os.urandom(16_344)},
    {"key_path": "A\\B", "name": "over", "reg_type": 3, "data": os.urandom(16_345)},
    {"key_path": "A\\B", "name": "£€", "reg_type": 4, "data": b"\1\2\3\4"},
    {"key_path": "A\\B", "name": "none", "reg_type": 77, "data": b""},
]


def image():
    return hivewriter.build(KEYS, VALUES)


def test_image_round_trip():
    t = regf.Image("h", image(), tolerant=False).parse()
    assert {(v[3], v[4]): (v[6], v[11]) for v in t["values"]} == {(v["key_path"], v["name"]): (v["reg_type"], v["data"]) for v in VALUES}
    assert {k[3] for k in t["keys"]} == {"", "A", "Wide"} | {k["path"] for k in KEYS}
    assert t["hives"][0][-1] == t["hives"][0][-2] and not t["errors"]
    assert hivewriter.lh_hash("Ab") == 65 * 37 + 66


def corrupted(name: str) -> bytes:
    d = bytearray(image())
    (root,) = struct.unpack_from("<I", d, 36)
    at = 4096 + root + 4
    (lists,) = struct.unpack_from("<I", d, at + 28)
    puts = {
        "signature": (0, b"XXXX"), "bin": (4096, b"XXXX"), "bin_size": (4096 + 8, b"\1\0\0\0"), "root_far": (36, b"\xf0\xff\xff\x7f"), "nk": (at, b"zz"),
        "list_far": (at + 28, b"\xf0\xff\xff\x7f"), "list_sig": (4096 + lists + 4, b"zz"), "many": (at + 20, b"\xff\xff\xff\x7f"), "cycle": (4096 + lists + 8, struct.pack("<I", root)), "cell_zero": (4096 + 32, b"\0\0\0\0"),
    }
    off, new = puts[name]
    d[off : off + len(new)] = new
    return bytes(d)


@pytest.mark.parametrize("name", ["signature", "bin", "bin_size", "root_far", "nk", "list_far", "list_sig", "many", "cycle", "cell_zero"])
def test_corruption(name):
    t = regf.Image("h", corrupted(name)).parse()
    assert t["errors"]
    with pytest.raises((regf.HiveError, struct.error)):
        regf.Image("h", corrupted(name), tolerant=False).parse()
    for cut in (0, 10, 4096, 5000):
        regf.Image("h", image()[:cut]).parse()


def test_diagnose_and_repair(spark):
    d = bytearray(image())
    d[8:12] = b"\x09\0\0\0"
    files = spark.createDataFrame([("h", bytearray(d))], "hive_id string, content binary")
    tables = lambda f: [regf.take_apart(f, x, id_col="hive_id") for x in ("hives", "hbins", "cells", "keys", "refs")]
    found = checks.diagnose(*tables(files)).where("severity <> 'info'").cache()
    assert {r.issue for r in found.collect()} == {"sequence numbers differ", "checksum differs"}
    assert checks.has_errors(found).first()[0]
    assert {r["n"] for r in checks.severity_summary(found).collect()} == {1}
    assert export.diagnostic_lines(found).count() == 2 and export.hex_annotations(found).count() == 2
    fixed = repair.apply(files, repair.plan(found))
    assert checks.diagnose(*tables(fixed.select("hive_id", "content"))).where("severity <> 'info'").count() == 0
    assert bytes(repair.apply(files, repair.plan(found), dry_run=True).first()["content"]) == bytes(d)


def test_record_repairs():
    whole = image()
    (root,) = struct.unpack_from("<I", whole, 36)
    place = 4096 + root + 4
    got, log = repair.patch(whole, [(place + 20, "subkey_count", 0), (place + 28, "subkey_list", regf.NONE)])
    after = regf.Image("h", got, tolerant=False).parse()
    assert len(log) == 2 and [(k[3], k[8]) for k in after["keys"]] == [("", 0)]
    assert repair.untouched(whole, got, [place + 20, place + 28, 508])
    for wrong in ((place + 24, "subkey_count", 0), (20, "value_count", 0), (len(whole) + 8, "value_size", 0)):
        got, log = repair.patch(whole, [(place + 20, "subkey_count", 0), wrong])
        assert got == whole and log[-1].endswith("all undone")


def test_safe_meets_an_image_once(spark):
    whole = image()
    (root,) = struct.unpack_from("<I", whole, 36)
    place = 4096 + root + 4
    files = spark.createDataFrame([("h", bytearray(whole))], "hive_id string, content binary")
    todo = [("h", 4, "sequence", 1), ("h", place + 20, "subkey_count", 0), ("h", place + 24, "subkey_count", 0), ("h", 508, "checksum", 0), ("h", 5002, "hbin_offset", 0), ("h", 8192, "hbin_offset", 0), ("h", 8192, "hbin_offset", 1), ("none", 4, "sequence", 1)]
    got = repair.safe(spark.createDataFrame(todo, "hive_id string, offset long, kind string, value long"), files)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert {(r.hive_id, r.offset, r.kind, r.value) for r in got.where("safe").collect()} == {todo[0], todo[1], todo[3]} and got.count() == len(todo)
    fixed = repair.apply(files, got.where("safe").drop("safe")).first()
    after = regf.Image("h", bytes(fixed["content"]), tolerant=False).parse()
    assert len(fixed["log"]) == 3 and after["hives"][0][-1] == after["hives"][0][-2]


def test_image_in_pieces():
    """What is held while an image is taken apart does not grow with it."""
    import tracemalloc

    whole, n, most = hivewriter.build([{"path": f"W{i % 7}\\k{i}"} for i in range(40_000)], []), 0, 0
    tracemalloc.start()
    for name, rows in regf.Image("h", memoryview(whole), tolerant=False).pieces():
        n, most = n + len(rows) * (name == "keys"), max(most, len(rows))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 40_008 and most <= regf.HELD + 100 and peak < 12 << 20


def test_writer_holds_offsets_only():
    import tracemalloc

    tracemalloc.start()
    image = hivewriter._Image()
    for i in range(40_000):
        image.key(["a", f"{i:06}"], ["A", f"{i:06}"])
        image.value("x", 3, b"12345678")
    size = len(image.finish())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * size
    t = regf.Image("h", image.data, tolerant=False).parse()
    assert len(t["keys"]) == 40_002 and len(t["values"]) == 40_000 and t["security"][0][4] == 40_002


def test_counts_that_an_image_can_hold(monkeypatch):
    monkeypatch.setattr(regf, "MOST_SUBKEYS", 1000)
    assert len(regf.Image("h", image(), tolerant=False).parse()["keys"]) == len(KEYS) + 3
    assert regf.Image("h", corrupted("many")).parse()["errors"]


def test_write_keeps_order_of_values(spark):
    keys = ["A", "A!b", "a\\C", "A\\b", "zero\0key\\x", "one\1", "\\lead", "日本\\é"]
    names = [f"v{(i * 7) % 10}" for i in range(10)]
    k = spark.createDataFrame([(h, p) for h in ("h", "g") for p in keys], "hive_id string, path string")
    v = spark.createDataFrame([(h, "A\\B", x, 4, bytearray(b"1234567")) for h in ("h", "g") for x in names], "hive_id string, key_path string, name string, reg_type int, data binary").coalesce(1)
    got = {r.hive_id: regf.Image(r.hive_id, bytes(r.image), tolerant=False).parse() for r in hivewriter.write(k, v).collect()}
    want = regf.Image("h", hivewriter.build([{"path": p} for p in keys], [{"key_path": "A\\B", "name": x, "reg_type": 4, "data": b"1234567"} for x in names]), tolerant=False).parse()
    for t in got.values():
        assert [x[3] for x in t["keys"]] == [x[3] for x in want["keys"]] == ["", "A", "A\\b", "A\\C", "A!b", "lead", "one\1", "zero\0key", "zero\0key\\x", "日本", "日本\\é"]
        assert [x[4] for x in t["values"]] == names and {x[3] for x in t["values"]} == {"A\\b"}


REG = """Windows Registry Editor Version 5.00

; a comment
[HKEY_LOCAL_MACHINE\\Software\\T]
@="default"
"q\\"uote"="back\\\\slash"
"n"=dword:000000ff
"bin"=hex:01,02,\\
  03
"m"=hex(7):61,00,00,00,00,00
"q"=hex(b):01,00,00,00,00,00,00,00
"gone"=-
[-HKEY_LOCAL_MACHINE\\Software\\Old]
[HKEY_LOCAL_MACHINE\\Software\\T]
"again"="x"
"""


def test_reg_parser(spark):
    ops = list(regtext.parse(REG))
    assert [o[0] for o in ops] == [CREATE, *[SET] * 6, DELETE_VALUE, DELETE_KEY, SET]
    assert ops[1][2:] == ("", 1, "default\0".encode("utf-16-le"))
    assert ops[2][2] == 'q"uote' and ops[2][4] == "back\\slash\0".encode("utf-16-le")
    assert ops[4][3:] == (3, b"\1\2\3") and ops[6][3] == 11
    for enc in ("utf-8", "utf-16-le"):
        f = spark.createDataFrame([("f", bytearray(REG.encode(enc)))], "path string, content binary")
        assert regtext.parse_files(f).where("path_norm = 'software\\\\t'").count() == 9


@pytest.mark.parametrize("bad", ['[A]\n"x"=dword:12', '"x"="y"', "[A\n", '[A]\n"x"=what', '[A]\n"x"="open'])
def test_reg_errors(bad):
    with pytest.raises(regtext.RegTextError):
        list(regtext.parse(bad))


def test_reg_lenient_and_header():
    assert len(list(regtext.parse('[A]\n"x"=dword:12\n"y"="z"', lenient=True))) == 2
    with pytest.raises(regtext.RegTextError):
        list(regtext.parse("[A]\n", missing_header=False))


def test_reg_files(spark, tmp_path):
    a, b = tmp_path / "a.reg", tmp_path / "b.reg"
    a.write_text('[A]\n"x"="1"\n')
    b.write_bytes(b"\xff\xfe" + '[A]\n"x"="2"\n'.encode("utf-16-le"))
    from regspark.operators import oplog
    from regspark.plans import apply

    ops = regtext.read(spark, str(a), str(b))
    assert apply.live_values(ops, ["data"]).collect()[0]["data"] == "2\0".encode("utf-16-le")
    assert oplog.optimize_stats(ops).first()["n_dedup"] == 2
    keys = spark.createDataFrame([("A",)], "path string")
    vals = ops.where("op = 'set_value'").limit(1).select(F.col("path").alias("key_path"), "name", "reg_type", "data")
    regtext.write(keys, vals, str(tmp_path / "out"), root="HKEY_LOCAL_MACHINE")
    assert regtext.read(spark, str(tmp_path / "out")).count() >= 2


def test_json(spark):
    keys = spark.createDataFrame([("A", "A", 1), ("A\\B", "B", 2)], "path string, name string, depth int")
    values = spark.createDataFrame([("A\\B", "", 4, bytearray(b"\1\0\0\0"))], "key_path string, name string, reg_type int, data binary")
    assert '"value": "1"' in export.json_tree(keys, values)
