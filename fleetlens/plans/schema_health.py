"""Growth, activity and bloat of tables and indexes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.operators import bloat as bl
from fleetlens.operators import catalog as cat
from fleetlens.operators import growth as gr
from fleetlens.schemas import POLL


@dataclass(frozen=True)
class CatalogSnapshots:
    """The snapshot tables of a schema poll."""

    schemata: DataFrame
    pg_class: DataFrame
    pg_namespace: DataFrame
    table_stat: DataFrame
    table_statio: DataFrame
    pg_index: DataFrame
    index_stat: DataFrame
    index_statio: DataFrame
    pg_indexes: DataFrame
    pg_constraint: DataFrame
    pg_stats: DataFrame


def bloat(s: CatalogSnapshots) -> DataFrame:
    widths = bl.bloat_columns(s.pg_stats)
    return bl.bloat_report(
        bl.bloat_tables(widths, s.pg_class, s.pg_namespace),
        bl.bloat_indexes(widths, s.pg_class, s.pg_namespace, s.pg_index),
    )


def table_objects(s: CatalogSnapshots) -> DataFrame:
    """Tables of reported schemas with counters and bloat."""
    sizes = cat.table_sizes(s.pg_class, s.pg_namespace)
    tables = cat.attach_table_stats(sizes, cat.table_stats(s.table_stat, s.table_statio))
    return cat.in_user_schemas(cat.attach_bloat(tables, bloat(s), "table"), cat.schemata_user(s.schemata))


def index_objects(s: CatalogSnapshots) -> DataFrame:
    """Indexes that hang on a table of a reported schema, with bloat and the unused flag."""
    indexes = cat.index_unused_flag(
        cat.index_stats(s.pg_index, s.pg_class, s.pg_namespace, s.index_stat, s.index_statio, s.pg_indexes),
        cat.unused_indexes(s.index_stat, s.pg_index, s.pg_constraint),
    )
    tables = cat.table_sizes(s.pg_class, s.pg_namespace).select(
        *POLL, "schema", F.col("name").alias("table_name")
    )
    hung = cat.attach_bloat(indexes, bloat(s), "index").join(tables, [*POLL, "schema", "table_name"], "left_semi")
    return cat.in_user_schemas(hung, cat.schemata_user(s.schemata))


def table_health(s: CatalogSnapshots) -> DataFrame:
    return gr.table_delta(table_objects(s))


def index_health(s: CatalogSnapshots) -> DataFrame:
    return gr.index_delta(index_objects(s))
