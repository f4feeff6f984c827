"""Registered queries with their DuckDB oracles."""


def all_entries():
    from wirelake.catalog import protocols, reports, streams, tables

    return tables.ENTRIES | protocols.ENTRIES | reports.ENTRIES | streams.ENTRIES
