"""Ranking the records of a table by how exposed they are."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tablerisk.operators.nearest import achilles_scores, top_vulnerable
from tablerisk.operators.prep import prepare_table
from tablerisk.spec import TableSpec


def vulnerability_ranking(df: DataFrame, spec: TableSpec, k: int = 5, n: int = 100) -> DataFrame:
    """Prepare the table, score every record, return the n most vulnerable ones."""
    prepared, coded = prepare_table(df, spec)
    return top_vulnerable(achilles_scores(prepared, coded, k), n)
