"""Limits, invariants and structural diagnosis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cols as c
from ..schema import Limits
from ..sources.regf import HEADER_SIZE, NONE, RECORD_FIELDS


def _row(rule: str, path: Column, detail: Column, most: int) -> Column:
    return F.struct(F.lit(rule).alias("rule"), path.alias("path"), detail.cast("long").alias("found"), F.lit(most).cast("long").alias("most"))


def validate(keys: DataFrame, values: DataFrame, limits: Limits) -> DataFrame:
    """All violations: rule, path, found, most."""
    p = F.col("path")
    per_key = {"depth": (F.col("depth"), limits.depth), "key_name": (F.char_length("name"), limits.key_name)}
    a = keys.select(F.explode(F.array(*(F.when(x > most, _row(rule, p, x, most)) for rule, (x, most) in per_key.items()))).alias("r"))
    kids = keys.groupBy(F.col("parent_path").alias("path")).agg(F.count("*").alias("n")).where(F.col("n") > limits.subkeys)
    kp = F.col("key_path")
    per_value = {"value_name": (F.char_length("name"), limits.value_name), "value_size": (F.col("size"), limits.value_size)}
    b = values.select(F.explode(F.array(*(F.when(x > most, _row(rule, kp, x, most)) for rule, (x, most) in per_value.items()))).alias("r"))
    many = values.groupBy(kp.alias("path")).agg(F.count("*").alias("n")).where(F.col("n") > limits.values)
    rows = a.where("r is not null").select("r.*").unionByName(b.where("r is not null").select("r.*"))
    whole = values.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).where(F.col("n") > limits.total_size)
    rows = rows.unionByName(whole.select(_row("total_size", F.lit(""), F.col("n"), limits.total_size).alias("r")).select("r.*"))
    rows = rows.unionByName(kids.select(_row("subkeys", p, F.col("n"), limits.subkeys).alias("r")).select("r.*"))
    return rows.unionByName(many.select(_row("values", p, F.col("n"), limits.values).alias("r")).select("r.*"))


def first_violation(violations: DataFrame) -> DataFrame:
    """The one that a walk from the root meets first."""
    return violations.orderBy(F.lower("path"), "rule").limit(1)


SEVERITIES = ("info", "warning", "error", "critical")


def severity_summary(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.groupBy("severity").agg(F.count("*").alias("n"), F.count_if(F.col("repair").isNotNull()).alias("n_repairable") if "repair" in diagnostics.columns else F.lit(0).alias("n_repairable"))


def auto_repairable(diagnostics: DataFrame, max_risk: str = "low") -> DataFrame:
    """Diagnostics with a repair that may run by itself, up to a risk."""
    order = ["none", "low", "medium", "high"]
    allowed = order[: order.index(max_risk) + 1]
    return diagnostics.where(F.col("repair.auto_apply") & F.col("repair.risk").isin(allowed))


def has_errors(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.agg(F.coalesce(F.bool_or(F.col("severity").isin("error", "critical")), F.lit(False)).alias("has_errors"))


def _diag(severity: str, structure: str, issue: str, offset: Column, expected: Column | None = None, actual: Column | None = None, repair: tuple | None = None, path: Column | None = None) -> list[Column]:
    text = lambda x: (x.cast("string") if x is not None else F.lit(None).cast("string"))
    kind = "struct<type:string,description:string,confidence:double,risk:string,auto_apply:boolean>"
    fix = F.struct(*(F.lit(v).alias(n) for v, n in zip(repair, ("type", "description", "confidence", "risk", "auto_apply"), strict=True))) if repair else F.lit(None).cast(kind)
    return [F.col("hive_id"), F.lit(severity).alias("severity"), F.lit("structure").alias("category"), offset.cast("long").alias("offset"), F.lit(structure).alias("structure"), F.lit(issue).alias("issue"), text(expected).alias("expected"), text(actual).alias("actual"), text(path).alias("key_path"), F.lit(None).cast("string").alias("value_name"), fix.cast(kind).alias("repair")]


def unreadable(errors: DataFrame) -> DataFrame:
    """Records that a walk could not read, as findings: what they are tells how grave it is."""
    issue = F.col("issue")
    severity = F.when(issue == "no REGF header", "critical").when(issue.startswith("data ") & issue.endswith("is short"), "warning").otherwise("error")
    structure = F.when(issue == "no REGF header", "REGF").when(issue.contains("HBIN"), "HBIN").when(issue.contains("list") | issue.contains("subkeys"), "list").when(issue.contains("value") | issue.contains("data"), "VK").when(issue.contains("key"), "NK").otherwise("cell")
    none = F.lit(None).cast("string")
    kind = "struct<type:string,description:string,confidence:double,risk:string,auto_apply:boolean>"
    return errors.select("hive_id", severity.alias("severity"), F.lit("structure").alias("category"), F.col("off").alias("offset"), structure.alias("structure"), "issue", none.alias("expected"), none.alias("actual"), none.alias("key_path"), none.alias("value_name"), F.lit(None).cast(kind).alias("repair"))


def _at(record: str, field: int) -> Column:
    """Place in the file of a field of a record."""
    return F.col(record) + HEADER_SIZE + 4 + field


def broken_records(keys: DataFrame, refs: DataFrame) -> list[DataFrame]:
    """Keys that count subkeys or values but whose list could not be read: both fields can be emptied, as nothing is reached by them."""
    out = []
    for what, ref, n in (("subkey", "key", "subkey_n"), ("value", "values", "value_n")):
        read = refs.where(F.col("kind") == ref).select("hive_id", F.col("src").alias("key_off"))
        lost = keys.where(F.col(n) > 0).join(read, ["hive_id", "key_off"], "left_anti")
        count, list_ = (RECORD_FIELDS[f"{what}_{x}"][1] for x in ("count", "list"))
        out.append(lost.select(_diag("error", "NK", f"{what} list cannot be read: count", _at("key_off", count), F.lit(0), F.col(n), (f"{what}_count", "set the count to 0", 0.7, "low", True), F.col("path"))))
        out.append(lost.select(_diag("error", "NK", f"{what} list cannot be read: offset", _at("key_off", list_), F.lit(NONE), None, (f"{what}_list", "set the offset to none", 0.9, "low", True), F.col("path"))))
    return out


def short_values(values: DataFrame) -> DataFrame:
    """Values with less data than their size says."""
    has = F.octet_length("data")
    return values.where(~F.col("inline") & (has < F.col("size"))).select(_diag("warning", "VK", "data is shorter than its size", _at("value_off", RECORD_FIELDS["value_size"][1]), has, F.col("size"), ("value_size", "cut the size to the data", 0.7, "low", True), F.col("key_path")))


def diagnose(hives: DataFrame, hbins: DataFrame, cells: DataFrame, keys: DataFrame, refs: DataFrame, errors: DataFrame | None = None, values: DataFrame | None = None) -> DataFrame:
    """Findings about images that regf.read() has taken apart; with `errors`, also what could not be read; with `values`, also short data.

    refs: hive_id, kind (what refers), src, dst (cell offsets). A cell in use
    that nothing reaches from the root is an orphan.
    """
    h = F.col
    out = [
        hives.where("primary_seq <> secondary_seq").select(_diag("warning", "REGF", "sequence numbers differ", F.lit(4), h("primary_seq"), h("secondary_seq"), ("sequence", "set the second to the first", 0.9, "low", True))),
        hives.where("checksum_stored <> checksum_calc").select(_diag("error", "REGF", "checksum differs", F.lit(508), h("checksum_calc"), h("checksum_stored"), ("checksum", "write the sum", 1.0, "low", True))),
        hives.where("root_cell % 8 <> 0").select(_diag("warning", "REGF", "root offset is not aligned", F.lit(36), None, h("root_cell"))),
        hives.where("root_cell >= data_size").select(_diag("critical", "REGF", "root offset is outside", F.lit(36), h("data_size"), h("root_cell"))),
        hbins.where("file_off_field <> abs_off - 4096").select(_diag("error", "HBIN", "offset field differs", h("abs_off") + 4, h("abs_off") - 4096, h("file_off_field"), ("hbin_offset", "write the offset", 0.95, "low", True))),
        hbins.where("size % 4096 <> 0 or size <= 0").select(_diag("critical", "HBIN", "size is not a multiple of a page", h("abs_off") + 8, None, h("size"))),
        cells.where("size < 8").select(_diag("error", "cell", "size under 8", h("off"), F.lit(8), h("size"))),
        keys.where("last_write_ft = 0").select(_diag("info", "NK", "no last write time", h("key_off"), path=h("path"))),
    ]
    used = cells.where("allocated").select("hive_id", h("off").alias("dst"))
    lost = refs.join(used, ["hive_id", "dst"], "left_anti").where("dst <> 4294967295")
    out.append(lost.select(_diag("error", "cell", "refers to no cell in use", h("src"), None, h("dst"), path=h("kind"))))
    reached = refs.select("hive_id", "dst").unionByName(hives.select("hive_id", h("root_cell").alias("dst"))).distinct()
    orphans = used.join(reached, ["hive_id", "dst"], "left_anti")
    out.append(orphans.groupBy("hive_id").agg(F.count("*").alias("n"), F.min("dst").alias("dst")).select(_diag("warning", "cell", "cells in use that nothing refers to", h("dst"), F.lit(0), h("n"))))
    out += broken_records(keys, refs)
    if errors is not None:
        out.append(unreadable(errors))
    if values is not None:
        out.append(short_values(values))
    rows = out[0]
    for x in out[1:]:
        rows = rows.unionByName(x)
    return rows


def security_counts(security: DataFrame, refs: DataFrame) -> DataFrame:
    """hive_id, off, ref_count (as stored), used (keys that refer to it) and holds of each security record."""
    used = refs.where("kind = 'security'").groupBy("hive_id", F.col("dst").alias("off")).agg(F.count("*").alias("used"))
    j = security.select("hive_id", "off", "ref_count").join(used, ["hive_id", "off"], "left").withColumn("used", F.coalesce("used", F.lit(0)))
    return j.withColumn("holds", F.col("used") == F.col("ref_count"))


def security_ring(security: DataFrame) -> DataFrame:
    """Security records whose neighbour does not point back: hive_id, off, neighbour."""
    back = security.select("hive_id", F.col("off").alias("flink"), F.col("blink").alias("back"))
    j = security.select("hive_id", "off", "flink").join(back, ["hive_id", "flink"], "left")
    return j.where(F.col("back").isNull() | (F.col("back") != F.col("off"))).select("hive_id", "off", F.col("flink").alias("neighbour"))


def verify(hives: DataFrame, hbins: DataFrame, cells: DataFrame) -> DataFrame:
    """One row for each hive and invariant: holds or not."""
    h = hives.select("hive_id", F.explode(F.array(
        F.struct(F.lit("sequence").alias("check"), (F.col("primary_seq") == F.col("secondary_seq")).alias("holds")),
        F.struct(F.lit("checksum").alias("check"), (F.col("checksum_stored") == F.col("checksum_calc")).alias("holds")),
        F.struct(F.lit("file_size").alias("check"), (F.col("file_size") >= F.col("data_size") + 4096).alias("holds")),
        F.struct(F.lit("root").alias("check"), ((F.col("root_cell") % 8 == 0) & (F.col("root_cell") < F.col("data_size"))).alias("holds")),
    )).alias("c")).select("hive_id", "c.check", "c.holds")
    b = hbins.groupBy("hive_id").agg(F.bool_and((F.col("size") % 4096 == 0) & (F.col("file_off_field") == F.col("abs_off") - 4096)).alias("holds")).select("hive_id", F.lit("hbins").alias("check"), "holds")
    e = cells.groupBy("hive_id").agg(F.bool_and((F.col("size") >= 8) & (F.col("size") % 8 == 0)).alias("holds")).select("hive_id", F.lit("cells").alias("check"), "holds")
    return h.unionByName(b).unionByName(e)
