"""Trees and findings as text and JSON rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cols as c


def text_tree(keys: DataFrame, max_depth: int | None = None, indent: int = 2) -> DataFrame:
    """preorder and line of each key; sort by preorder to print."""
    out = keys if max_depth is None else keys.where(F.col("depth") <= max_depth)
    return out.select(F.split("path_norm", r"\\").alias("preorder"), F.concat(F.repeat(F.lit(" "), (F.col("depth") - 1) * indent), "name").alias("line"))


def text_values(values: DataFrame, indent: int = 2, cut: int = 100) -> DataFrame:
    """preorder, name and line of each value, to go below its key's line; long contents are cut."""
    shown = c.display("reg_type", "data")
    shown = F.when(F.length(shown) > cut, F.concat(F.substring(shown, F.lit(1), F.lit(cut)), F.lit("..."))).otherwise(shown)
    called = F.when(F.col("name") == "", "(Default)").otherwise(F.col("name"))
    line = F.concat(F.repeat(F.lit(" "), c.depth("key_path") * indent), called, F.lit(" ["), c.type_name("reg_type"), F.lit("] = "), shown)
    return values.select(F.split(c.norm_path("key_path"), r"\\").alias("preorder"), "name", line.alias("line"))


#: Columns of a printed line, bytes of a continued one, and its indent.
WIDTH, CONTINUED, INDENT = 80, 25, "  "


def printed_values(values: DataFrame) -> DataFrame:
    """key_path, name and the text of each value as a printer writes it: all but numbers as typed hex bytes, wrapped at WIDTH columns."""
    from ..sources.regtext import name_text

    kind, d = F.col("reg_type"), F.coalesce("data", F.lit(b""))
    number = F.concat(F.lit("=dword:"), F.lower(F.lpad(F.hex(c.dword(d)), 8, "0")))
    tag = F.when(kind == 3, "=hex:").otherwise(F.concat(F.lit("=hex("), F.when(kind == 11, "b").otherwise(F.lower(F.hex(kind.cast("long")))), F.lit("):")))
    head = F.concat(name_text("name"), tag)
    first = F.greatest(F.lit(1), F.floor((WIDTH - 4 - F.char_length(head)) / 3) + 1).cast("int")  # bytes that the first line has room for
    listed = c.hex_list(d)
    rest = F.regexp_replace(F.substring(listed, 3 * first + 1, F.length(listed)), f"(.{{{3 * CONTINUED - 1}}}),", f"$1,\\\\\n{INDENT}")
    wrapped = F.when(F.octet_length(d) > first, F.concat(F.substring(listed, F.lit(1), 3 * first - 1), F.lit(f",\\\n{INDENT}"), rest)).otherwise(listed)
    return values.select("key_path", "name", F.when((kind == 4) & (F.octet_length(d) >= 4), F.concat(name_text("name"), number)).otherwise(F.concat(head, wrapped)).alias("line"))


def printed_keys(keys: DataFrame) -> DataFrame:
    """path and line of each key as a printer writes it: a separator in front, no root's name."""
    return keys.select("path", F.concat(F.lit("[\\"), c.clean_path("path"), F.lit("]")).alias("line"))


def json_keys(keys: DataFrame, values: DataFrame) -> DataFrame:
    """One JSON object for each key, its values sorted by name. values: reg_type, data."""
    shown = F.struct(F.when(F.col("name") == "", "(Default)").otherwise(F.col("name")).alias("name"), c.type_name("reg_type").alias("type"), c.display("reg_type", "data").alias("value"))
    v = values.groupBy(F.col("key_path").alias("path")).agg(F.sort_array(F.collect_list(shown)).alias("values"))
    j = keys.join(v, "path", "left")
    body = F.struct("path", "name", "depth", F.coalesce("values", F.array().cast(v.schema["values"].dataType)).alias("values"))
    return j.select("path", F.to_json(body).alias("json"))


def json_tree(keys: DataFrame, values: DataFrame, root: str = "ROOT") -> str:
    """One nested JSON document of a (sub)tree that fits the driver."""
    import json

    nodes: dict[str, dict] = {"": {"name": root, "values": [], "children": []}}
    for r in json_keys(keys, values).orderBy(F.length("path"), "path").toLocalIterator():
        x = json.loads(r["json"])
        node = {"name": x["name"], "values": x["values"], "children": []}
        nodes[r["path"]] = node
        nodes.get(r["path"].rpartition(c.SEP)[0], nodes[""])["children"].append(node)
    return json.dumps(nodes[""], ensure_ascii=False)


def diagnostic_lines(diagnostics: DataFrame) -> DataFrame:
    at = F.concat(F.lit("0x"), F.lower(F.hex("offset")))
    line = F.concat(F.lit("["), F.upper("severity"), F.lit("] "), "structure", F.lit(" at "), at, F.lit(": "), "issue", F.coalesce(F.concat(F.lit(" (expected "), "expected", F.lit(")")), F.lit("")), F.coalesce(F.concat(F.lit(" (found "), "actual", F.lit(")")), F.lit("")))
    return diagnostics.select("hive_id", "offset", line.alias("line"))


def diagnostic_json(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.select("hive_id", "offset", F.to_json(F.struct(*diagnostics.columns)).alias("json"))


def hex_annotations(diagnostics: DataFrame) -> DataFrame:
    """`offset,structure,issue`, commas in the issue as semicolons."""
    return diagnostics.select("hive_id", "offset", F.concat_ws(",", F.concat(F.lit("0x"), F.lpad(F.lower(F.hex("offset")), 8, "0")), "structure", F.replace(F.col("issue"), F.lit(","), F.lit(";"))).alias("line"))
