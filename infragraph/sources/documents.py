"""Documents in: reading, classifying and decoding (S1 to S4), and what all sources share.

A decoded document is a row (path, doc_no, body) with ``body`` as JSON text. Values inside are read with
``from_json`` into maps of strings, where nested values stay JSON text, so loosely typed fields are branched
on with ``coalesce``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from infragraph.functions.scalar import after_last, edge_id
from infragraph.functions.schema import NODE_COLUMNS

SKIPPED = r"(^|/)(\.git|node_modules|vendor|dist|build)(/|$)"
MAP, LIST, MAPS = "map<string,string>", "array<string>", "array<map<string,string>>"
Tables = tuple[DataFrame, DataFrame, DataFrame]


def classify_source(path: str | Column = "path") -> Column:
    """The source of a file by its path, null if unknown; rules are tried in order."""
    p = F.lower(F.col(path) if isinstance(path, str) else path)
    base = after_last(p, "/")
    yaml = base.endswith(".yml") | base.endswith(".yaml")
    cfn = p.contains("cloudformation") | p.contains("/cfn/")
    return (
        F.when(base.endswith(".tfstate"), "terraform")
        .when(base.startswith("tfplan") & base.endswith(".json"), "terraform-plan")
        .when(base.startswith("docker-compose") & yaml, "compose")
        .when(cfn, F.when(yaml | base.endswith(".json"), "cloudformation"))  # no other rule is tried
        .when(p.contains("pulumi") & base.endswith(".json"), "pulumi")
        .when(p.contains("ansible") & (base.endswith(".ini") | yaml), "ansible")
        .when(yaml, "kubernetes")
    )


def read_documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, source, text) of all files of known sources below ``paths``."""
    raw = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(paths)
    rows = raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows.where(~F.col("path").rlike(SKIPPED)).withColumn("source", classify_source()).where("source is not null").select("path", "source", "text")


def yaml_to_json(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds ``body``: the YAML of ``text`` as JSON, null if it is broken."""
    import yaml

    class Plain(yaml.SafeLoader):
        """Dates stay text, and unknown tags (short intrinsic functions) become maps of their long names."""

    Plain.yaml_implicit_resolvers = {k: [r for r in v if r[0] != "tag:yaml.org,2002:timestamp"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}

    def tagged(loader: yaml.SafeLoader, suffix: str, node: yaml.Node):
        if isinstance(node, yaml.ScalarNode):
            value = loader.construct_scalar(node)
        elif isinstance(node, yaml.SequenceNode):
            value = loader.construct_sequence(node, deep=True)
        else:
            value = loader.construct_mapping(node, deep=True)
        if suffix == "GetAtt" and isinstance(value, str):
            value = value.split(".", 1)
        return {suffix if suffix in ("Ref", "Condition") else f"Fn::{suffix}": value}

    Plain.add_multi_constructor("!", tagged)

    def convert(text: str) -> str | None:
        try:
            return json.dumps(yaml.load(text, Loader=Plain), default=str)
        except (yaml.YAMLError, ValueError, TypeError, RecursionError):
            return None

    for pdf in batches:
        yield pdf.assign(body=pdf["text"].map(convert))


def decode_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S3: (path, doc_no, body) and warnings.

    A text that starts like JSON stays native; other texts are cut at ``---`` lines, blanks dropped, and
    their YAML turned into JSON. A broken document is a warning. ``*List`` documents give their items.
    """
    is_json = F.col("text").rlike(r"^\s*[\[{]")
    native = docs.where(is_json).select("path", F.lit(0).alias("doc_no"), "text", F.col("text").alias("body"))
    cut = docs.where(~is_json).select("path", F.posexplode(F.split("text", "(^|\n)---[^\n]*")).alias("doc_no", "text")).where(F.col("text").rlike(r"\S"))
    rows = native.unionByName(cut.mapInPandas(yaml_to_json, "path string, doc_no int, text string, body string"))
    good = F.from_json("body", MAP).isNotNull() | F.from_json("body", LIST).isNotNull()
    rows = rows.withColumn("good", good & (F.coalesce("body", F.lit("null")) != "null"))
    bad = rows.where(~F.col("good")).select(F.col("path").alias("source_file"), F.format_string("document %d cannot be decoded", "doc_no").alias("message"))
    top = F.from_json("body", MAP)
    items = F.when(F.coalesce(top["kind"], F.lit("")).endswith("List") & top["items"].isNotNull(), F.from_json(top["items"], LIST)).otherwise(F.array("body"))
    out = rows.where("good").select("path", "doc_no", F.posexplode(items).alias("item", "body"))
    return out.select("path", (F.col("doc_no") * 100_000 + F.col("item")).alias("doc_no"), "body"), bad


def read_states(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JSON texts as (path, doc_no, body); malformed ones become warnings."""
    rows = docs.select("path", F.lit(0).alias("doc_no"), F.col("text").alias("body"))
    good = F.from_json("body", MAP).isNotNull()
    return rows.where(good), rows.where(~good).select(F.col("path").alias("source_file"), F.lit("invalid JSON").alias("message"))


def js(c: Column | str, kind: str = MAP) -> Column:
    return F.from_json(c, kind)


def empty_map() -> Column:
    return F.create_map().cast(MAP)


def pairs(*named: tuple[str, Column]) -> Column:
    """A map of the entries whose value is neither null nor empty."""
    return F.map_filter(F.create_map(*[x for k, v in named for x in (F.lit(k), v)]), lambda k, v: v.isNotNull() & (v != ""))


def picked(attrs: Column, keys: list[str]) -> Column:
    """The non-empty values of some keys."""
    return F.map_filter(attrs, lambda k, v: k.isin(keys) & v.isNotNull() & (v != ""))


def prefixed(m: Column, prefix: str) -> Column:
    return F.transform_keys(F.map_filter(F.coalesce(m, empty_map()), lambda k, v: v.isNotNull()), lambda k, v: F.concat(F.lit(prefix), k))


def merged(*maps: Column) -> Column:
    """One map; a later one wins."""
    out = F.coalesce(maps[0], empty_map())
    for m in maps[1:]:
        out = _over(out, F.coalesce(m, empty_map()))
    return out


def _over(low: Column, high: Column) -> Column:
    return F.map_concat(F.map_filter(low, lambda k, v: ~F.map_contains_key(high, k)), high)


def nodes_of(df: DataFrame, as_of: Column, **columns: Column) -> DataFrame:
    """NODE rows; what is not given is empty, and a node is first and last seen at ``as_of``."""
    given = {"source_file": F.col("path"), "provider": F.lit(""), "metadata": empty_map(), "expires_at": F.lit(None).cast("timestamp"), "last_seen": as_of, "first_seen": as_of} | columns
    return df.select(*[given[c].alias(c) for c in NODE_COLUMNS])


def edges_of(df: DataFrame, from_id: Column, to_id: Column, kind: str | Column, **meta: Column) -> DataFrame:
    """EDGE rows."""
    t = F.lit(kind) if isinstance(kind, str) else kind
    return df.select(edge_id(from_id, t, to_id).alias("id"), from_id.alias("from_id"), to_id.alias("to_id"), t.alias("type"), pairs(*meta.items()).alias("metadata") if meta else empty_map().alias("metadata"))


def first_of(edges: DataFrame, order: str | None = None) -> DataFrame:
    """One row for each edge id: the one with the smallest ``order``, else the smallest metadata text."""
    key = F.col(order) if order else F.to_json("metadata")
    best = edges.groupBy("id").agg(F.min_by(F.struct("from_id", "to_id", "type", "metadata"), F.struct(key, F.to_json("metadata"))).alias("e"))
    return best.select("id", "e.from_id", "e.to_id", "e.type", "e.metadata")


def last_nodes(nodes: DataFrame) -> DataFrame:
    """One row for each node id, the last file wins."""
    rest = [c for c in nodes.columns if c != "id"]
    best = nodes.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("source_file", F.to_json("metadata"))).alias("n"))
    return best.select(*[F.col(c) if c == "id" else F.col(f"n.{c}").alias(c) for c in nodes.columns])


def by_suffix(wanted: DataFrame, value: str, ids: DataFrame) -> DataFrame:
    """``wanted`` with ``target``: the smallest node id that ends with ``:<value>``.

    The ids' suffixes after each colon are written out, so this is an equi-join.
    """
    parts = F.split("node_id", ":")
    tails = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ":"))
    known = ids.where(F.col("node_id").contains(":")).select("node_id", F.explode(tails).alias("tail")).groupBy("tail").agg(F.min("node_id").alias("target"))
    return wanted.join(known, F.col(value) == F.col("tail")).drop("tail")


#: Y2: source -> function of (docs, as_of) that returns nodes, edges and warnings.
PARSERS: dict[str, Callable[[DataFrame, Column], Tables]] = {}


def register_parser(source: str) -> Callable[[Callable[[DataFrame, Column], Tables]], Callable[[DataFrame, Column], Tables]]:
    def add(f: Callable[[DataFrame, Column], Tables]) -> Callable[[DataFrame, Column], Tables]:
        PARSERS[source] = f
        return f

    return add


def ingest(docs: DataFrame, as_of: Column) -> Tables:
    """All registered parsers over documents (path, source, text)."""
    import infragraph.sources.all_parsers  # noqa: F401  registers them

    out: Tables | None = None
    for source, parse in sorted(PARSERS.items()):
        got = parse(docs.where(F.col("source") == source), as_of)
        out = got if out is None else tuple(a.unionByName(b) for a, b in zip(out, got, strict=True))
    return out
