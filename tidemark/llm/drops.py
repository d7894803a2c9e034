"""Applying decisions about documents to the documents themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def unused(taken: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores behind it as keep it apart from the columns ``taken``."""
    known, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in known:
            name += "_"
        known.add(name.lower())
        out.append(name)
    return out


def without_rows(docs: DataFrame, keys: DataFrame, values: list[Column]) -> DataFrame:
    """``docs`` without the rows whose ``values`` equal a row of ``keys``; NULL equals NULL, all columns stay.

    Always a merge join: the keys grow with the documents, so a broadcast would
    only hold for small tables. Texts are shuffled once.
    """
    names = unused(docs.columns, *[f"key{k}" for k in range(len(values))])
    keys = keys.toDF(*names)
    return docs.join(keys.hint("merge"), [keys[name].eqNullSafe(value) for name, value in zip(names, values)], "left_anti")
