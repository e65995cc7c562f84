"""Providers: from a configuration's connection settings to DataFrames by table name."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.sources.interpolate import interpolate
from weftgraph.sources.properties import quoted

Tables = Callable[[str], DataFrame]
Provider = Callable[[SparkSession, dict[str, Any]], Tables]
PROVIDERS: dict[str, Provider] = {}


def provider(*names: str) -> Callable[[Provider], Provider]:
    """Register a provider under names that a configuration's ``class`` may end in."""

    def register(f: Provider) -> Provider:
        for n in names:
            PROVIDERS[n.lower()] = f
        return f

    return register


@provider("parquet", "orc", "csv", "json")
def files(spark: SparkSession, config: dict[str, Any]) -> Tables:
    """Tables are files ``<path>/<table>.<format>`` (or ``path`` with ``{table}`` in it)."""
    form = config.get("format") or config["class"].lower()
    pattern = config["path"] if "{table}" in config["path"] else f"{config['path'].rstrip('/')}/{{table}}.{form}"
    options = dict(config.get("options", {}))
    if form == "csv":
        options = {"header": "true", "inferSchema": "true"} | options
    return lambda name: spark.read.format(form).options(**options).load(pattern.replace("{table}", name))


@provider("view", "table")
def views(spark: SparkSession, config: dict[str, Any]) -> Tables:
    """Tables are temporary views or catalog tables."""
    return spark.table


@provider("JdbcSourceProvider", "jdbc")
def jdbc(spark: SparkSession, config: dict[str, Any]) -> Tables:
    """Tables of a database. ``partitions`` maps a table to the column, bounds and number of its parallel reads."""
    address = config["address"]
    options = {"url": address[0] if isinstance(address, list) else address, "driver": config.get("driver"), "user": config.get("user"), "password": config.get("password")}
    options = {k: v for k, v in options.items() if v is not None}

    def table(name: str) -> DataFrame:
        return spark.read.format("jdbc").options(**options, dbtable=name, **config.get("partitions", {}).get(name, {})).load()

    return table


@provider("ElasticSourceProvider", "documents")
def documents(spark: SparkSession, config: dict[str, Any]) -> Tables:
    """Indices are folders or files of JSON lines below ``path``; ``*`` reads all, and a property reference all as well."""

    def table(name: str) -> DataFrame:
        name = "*" if name.startswith("@") else name
        return spark.read.json(f"{config['path'].rstrip('/')}/{name}" + ("" if name.endswith("*") else ".json"))

    return table


@provider("RestSourceProvider", "rest")
def rest(spark: SparkSession, config: dict[str, Any]) -> Tables:
    """Resources are stored responses ``<path>/<resource>.json``; their rows lie at the dotted ``resultPath``. No wire protocol is spoken."""

    def table(name: str) -> DataFrame:
        df = spark.read.option("multiLine", "true").json(f"{config['path'].rstrip('/')}/{name}.json")
        if at := config.get("resultPath"):
            df = df.select(F.explode(quoted(at)).alias("row")).select("row.*")
        return df

    return table


def given(tables: dict[str, DataFrame]) -> Tables:
    """Tables that are at hand, by name in any case."""
    lower = {k.lower(): v for k, v in tables.items()}
    return lambda name: lower[name.lower()]


def tables_of(spark: SparkSession, config: dict[str, Any]) -> Tables:
    name = str(config.get("class", "parquet")).rpartition(".")[2].lower()
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {config.get('class')!r}; there are {sorted(PROVIDERS)}")
    return PROVIDERS[name](spark, config)


def load(path: str) -> list[dict[str, Any]]:
    """The provider configurations of a file, or of all JSON files of a folder, interpolated."""
    found = sorted(Path(path).rglob("*.json")) if Path(path).is_dir() else [Path(path)]
    return [interpolate(json.loads(p.read_text()), where=str(p)) for p in found]
