"""All registered queries and oracles of this library."""

from keyloom.plans import files, reads, registry, shapes, writes

_loaded = (files, reads, shapes, writes)


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.ORACLES)
