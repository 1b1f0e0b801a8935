"""Search over names and data, and filters that keep the way to each match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cols as c
from .read import norm


def matches(col: Column | str, text: str, regex: bool = False, case_sensitive: bool = False) -> Column:
    x = F.col(col) if isinstance(col, str) else col
    if regex:
        return x.rlike(text if case_sensitive else "(?i)" + text)
    return x.contains(text) if case_sensitive else F.lower(x).contains(text.lower())


def search_keys(keys: DataFrame, text: str, top: str = "", limit: int | None = None, whole_path: bool = False, **how) -> DataFrame:
    """Keys whose name (or path) matches; with a limit, the first by path."""
    out = keys.where(matches("path" if whole_path else "name", text, **how))
    out = out.where(c.under("path_norm", norm(top))) if top else out
    return out.orderBy("path").limit(limit) if limit is not None else out


def search_values(values: DataFrame, text: str, top: str = "", limit: int | None = None, **how) -> DataFrame:
    """Values whose name or text data matches; numbers are not searched."""
    hit = matches("name", text, **how) | matches(F.coalesce("string_val", F.lit("")), text, **how)
    if "string_vals" in values.columns:
        hit |= F.exists(F.coalesce("string_vals", F.array().cast("array<string>")), lambda s: matches(s, text, **how))
    out = values.where(hit)
    out = out.where(c.norm_path("key_path").startswith(norm(top) + c.SEP)) if top else out
    return out.orderBy("key_path", "name").limit(limit) if limit is not None else out


def global_search(values: DataFrame, shown: Column, text: str) -> DataFrame:
    """Per key the values that match and the best place: name before type before data."""
    low = text.lower()
    place = F.when(F.lower("name").contains(low), 1).when(F.lower(c.type_name("reg_type")).contains(low), 2).when(F.lower(shown).contains(low), 3)
    hit = values.withColumn("place", place).where("place is not null")
    out = hit.groupBy("key_path").agg(F.count("*").alias("n_matches"), F.min("place").alias("place"))
    return out.select("key_path", "n_matches", F.element_at(F.array(*map(F.lit, ("name", "type", "value"))), F.col("place")).alias("matched_in"))


def with_ancestors(keys: DataFrame, hits: DataFrame) -> DataFrame:
    """Keys that are a hit or an ancestor of one. hits: path_norm."""
    way = hits.select(F.explode(c.ancestors("path_norm", itself=True)).alias("path_norm")).distinct()
    return keys.join(way, "path_norm", "left_semi")


def filter_tree(keys: DataFrame, text: str) -> DataFrame:
    """Keys whose name has the text, with their ancestors; under three characters filter nothing."""
    return keys if len(text) < 3 else with_ancestors(keys, search_keys(keys, text))


def filter_paths(keys: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: path, in any spelling. The keys of these paths that exist, and those above them."""
    w = wanted.select(c.norm_path("path").alias("path_norm")).distinct()
    return with_ancestors(keys, keys.join(w, "path_norm", "left_semi"))
