"""Deleting parents removes their children, as the schema declares.

``Table.cascade`` names the parents whose deletion reaches a table through its
foreign keys. Deleted keys go down the graph level by level until no new ones
appear: a level finds the children of all keys that the last one deleted (semi
joins), leaves out those deleted already (so diamonds and cycles end), and is
written before the next starts, so no level repeats the work above it and
nothing is collected. Keys may be composite; a NULL reference never matches.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from hearthvale.schemas import TABLES, Table
from hearthvale.session import staged


def deleted_keys(tables: Mapping[str, DataFrame], first: Mapping[str, DataFrame],
                 spec: Mapping[str, Table] = TABLES) -> dict[str, DataFrame]:
    """Primary keys that go, per table, when the rows of ``first`` (table ->
    keys) are deleted; a key that no row has goes nowhere."""
    def rows_with(name: str, keys: DataFrame) -> DataFrame:
        pk = list(spec[name].pk)
        return tables[name].select(*pk).join(keys.select(*pk).distinct(), pk, "left_semi").distinct()

    level = {name: staged(rows_with(name, keys), f"cascade-{name}") for name, keys in first.items()}
    gone = dict(level)
    while level:
        found: dict[str, DataFrame] = {}
        for child, t in spec.items():
            for cols, parent, parent_cols in t.fks:
                if child not in tables or parent not in t.cascade or parent not in level:
                    continue
                keys = level[parent]
                if not set(parent_cols) <= set(spec[parent].pk):          # a reference to a column outside the key
                    keys = tables[parent].join(keys, list(spec[parent].pk), "left_semi")
                refs = keys.select(*[keys[b].alias(a) for a, b in zip(cols, parent_cols)]).distinct()
                dead = tables[child].join(refs, list(cols), "left_semi").select(*t.pk)
                found[child] = found[child].unionByName(dead) if child in found else dead
        level = {}
        for child, dead in found.items():
            dead = dead.distinct()
            if child in gone:
                dead = dead.join(gone[child], list(spec[child].pk), "left_anti")
            dead = staged(dead, f"cascade-{child}")
            if not dead.isEmpty():
                level[child] = dead
                gone[child] = gone[child].unionByName(dead) if child in gone else dead
    return gone


def cascade_delete(tables: Mapping[str, DataFrame], parent: str, gone: DataFrame,
                   spec: Mapping[str, Table] = TABLES) -> dict[str, DataFrame]:
    """The tables after deleting the rows of ``parent`` whose primary key is in
    ``gone`` (columns of that key)."""
    out = dict(tables)
    for name, keys in deleted_keys(tables, {parent: gone}, spec).items():
        out[name] = out[name].join(keys, list(spec[name].pk), "left_anti")
    return out
