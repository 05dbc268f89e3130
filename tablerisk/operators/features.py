"""Turning datasets into feature rows, in long form: keys, feature_pos, feature, value."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablerisk.functions.durable import broadcast_if_small, stored_side
from tablerisk.functions.ranks import grouped_quantile
from tablerisk.operators.counts import comparable, target_counts
from tablerisk.operators.nearest import closest_rows, distance_features, record_similarity
from tablerisk.operators.querysets import lattice_size, query_lattice
from tablerisk.spec import ID, TableSpec

KEYS = ("target_id", "dataset_id")
LATTICE_COLUMNS = 20


def _stack(wide: DataFrame, keys: Sequence[str], named: list[tuple[Column | str, Column]]):
    """Turn named columns into long rows; positions follow the list."""
    entries = [
        F.struct(
            F.lit(i).cast("bigint").alias("feature_pos"),
            (F.lit(name) if isinstance(name, str) else name).alias("feature"),
            value.cast("double").alias("value"),
        )
        for i, (name, value) in enumerate(named)
    ]
    return wide.select(*keys, F.explode(F.array(*entries)).alias("f")).select(*keys, "f.*")


def _place(spec: TableSpec, column: str) -> Column:
    """Position of a category in its declared domain; null outside it."""
    pairs = [F.lit(x) for k, v in enumerate(spec.domain[column]) for x in (str(v), k)]
    return F.create_map(*pairs)[F.col(f"`{column}`").cast("string")]


def naive_features(tables: DataFrame, spec: TableSpec, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per dataset: mean, median and population variance of every continuous column; number of
    present categories, most and least frequent code of every categorical column.

    Frequencies run over the declared domain, so an absent category wins "least frequent"; ties go
    to the first category of the domain.
    """
    keys = list(keys)
    continuous, categorical = list(spec.continuous), list(spec.categorical)
    wide = tables.groupBy(*keys).agg(
        *[F.avg(f"`{c}`").alias(f"mean_{c}") for c in continuous],
        *[F.var_pop(f"`{c}`").alias(f"var_{c}") for c in continuous],
        F.count(F.lit(1)).alias("__n"),
    )
    for c in continuous:
        wide = wide.join(grouped_quantile(tables, keys, c, 0.5, f"median_{c}"), keys, "left")
    named = [(f"{kind}_{c}", F.col(f"`{kind}_{c}`")) for kind in ("mean", "median", "var") for c in continuous]
    if categorical:
        # (column, code) counts are combined map-side; a group then holds at most one domain
        cells = F.array(
            *[
                F.struct(F.lit(i).alias("at"), _place(spec, c).alias("place"))
                for i, c in enumerate(categorical)
            ]
        )
        counts = (
            tables.select(*keys, F.explode(cells).alias("cell"))
            .filter("cell.place is not null")
            .groupBy(*keys, "cell")
            .agg(F.count(F.lit(1)).alias("n"))
            .groupBy(*keys)
            .agg(F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("__counts"))
        )
        wide = wide.join(counts, keys, "left")
        for i, c in enumerate(categorical):
            seen = F.array(
                *[
                    F.struct(
                        F.coalesce(
                            F.col("__counts")[
                                F.struct(F.lit(i).alias("at"), F.lit(place).alias("place"))
                            ],
                            F.lit(0).cast("bigint"),
                        ).alias("n"),
                        F.lit(place).alias("place"),
                    )
                    for place in range(len(spec.domain[c]))
                ]
            )
            name = f"__seen{i}"
            wide = wide.withColumn(name, seen)
            most = F.array_max(
                F.transform(name, lambda s: F.struct(s["n"].alias("n"), (-s["place"]).alias("p")))
            )["p"]
            least = F.array_min(F.col(name))["place"]
            present = F.size(F.filter(name, lambda s: s["n"] > 0))
            codes = F.array(*[F.lit(float(v)) for v in spec.domain[c]])
            named += [
                (f"{c}_distinct", present),
                (f"{c}_most_freq", F.element_at(codes, -most + 1)),
                (f"{c}_least_freq", F.element_at(codes, least + 1)),
            ]
    return _stack(wide, keys, named)


def correlation_features(
    tables: DataFrame, spec: TableSpec, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Pearson correlation of every column pair (continuous, then one-hot), undefined -> 0.

    Every record contributes the products of its non-zero entries only: continuous values and one
    active code per categorical column. Those are summed per (dataset, pair) with map-side
    combining; pairs that never meet have product sum 0. Continuous values are shifted by the
    dataset's minimum, which keeps constants exactly constant.
    """
    keys = list(keys)
    continuous = list(spec.continuous)
    names = continuous + [f"{c}_{v}" for c in spec.categorical for v in spec.domain[c]]
    lows = tables.groupBy(*keys).agg(
        *[F.min(f"`{c}`").alias(f"__lo{i}") for i, c in enumerate(continuous)],
        F.count(F.lit(1)).alias("__n"),
    )
    shifted = tables.join(stored_side(lows), keys)
    # entry 0 is the constant 1, entry i + 1 is column i
    entries = [F.struct(F.lit(0).alias("at"), F.lit(1.0).alias("x"))]
    for i, c in enumerate(continuous):
        value = F.col(f"`{c}`").cast("double") - F.col(f"__lo{i}")
        entries.append(F.struct(F.lit(i + 1).alias("at"), value.alias("x")))
    start = len(continuous) + 1
    for c in spec.categorical:
        entries.append(
            F.struct((_place(spec, c) + start).alias("at"), F.lit(1.0).alias("x"))
        )
        start += len(spec.domain[c])
    pairs = F.array(
        *[
            F.struct(
                entries[i]["at"].alias("i"),
                entries[j]["at"].alias("j"),
                (entries[i]["x"] * entries[j]["x"]).alias("xy"),
            )
            for i in range(len(entries))
            for j in range(i, len(entries))
        ]
    )
    sums = (
        shifted.select(*keys, F.explode(pairs).alias("p"))
        .filter("p.i is not null and p.j is not null")
        .groupBy(*keys, "p.i", "p.j")
        .agg(F.sum("p.xy").alias("xy"))
        .groupBy(*keys)
        .agg(F.map_from_entries(F.collect_list(F.struct(F.struct("i", "j"), "xy"))).alias("m"))
    )
    width = len(names)
    grid = F.explode(
        F.flatten(
            F.transform(
                F.sequence(F.lit(1), F.lit(width)),
                lambda i: F.transform(
                    F.filter(F.sequence(F.lit(1), F.lit(width)), lambda j: j > i),
                    lambda j: F.struct(i.alias("i"), j.alias("j")),
                ),
            )
        )
    )

    def moment(i: Column, j: Column) -> Column:
        return F.coalesce(F.col("m")[F.struct(i.alias("i"), j.alias("j"))], F.lit(0.0))

    one, i, j = F.lit(0), F.col("g.i"), F.col("g.j")
    out = sums.withColumn("g", grid).select(
        *keys,
        i.alias("i"),
        j.alias("j"),
        moment(one, one).alias("n"),
        moment(one, i).alias("sx"),
        moment(one, j).alias("sy"),
        moment(i, i).alias("sxx"),
        moment(j, j).alias("syy"),
        moment(i, j).alias("sxy"),
    )
    vx = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    vy = F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")
    cov = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    defined = (vx > F.lit(1e-12) * F.col("n") * F.col("sxx")) & (
        vy > F.lit(1e-12) * F.col("n") * F.col("syy")
    )
    corr = F.when(defined, cov / (F.sqrt(vx) * F.sqrt(vy))).otherwise(0.0)
    # row-major position in the strict upper triangle
    before = (F.col("i") - 1) * width - F.floor(F.col("i") * (F.col("i") - 1) / 2)
    position = (before + F.col("j") - F.col("i") - 1).cast("bigint")
    return out.select(
        *keys,
        position.alias("feature_pos"),
        F.concat(F.lit("corr_"), position).alias("feature"),
        corr.alias("value"),
    )


def query_features(
    tables: DataFrame,
    spec: TableSpec,
    targets: DataFrame,
    orders: Sequence[int],
    cat_options: Sequence[int] = (1,),
    cont_options: Sequence[int] = (3,),
    limit: int | None = None,
    seed: int = 42,
    keys: Sequence[str] = KEYS,
    int_domain: bool = True,
) -> DataFrame:
    """Exact counts of all lattice queries with the target's values, per dataset.

    With one option per column and no sampling, every record is a bit mask of fulfilled
    conditions; masks are counted first and each dataset's superset sums give all its answers at
    once. A dataset then is at most 2^columns rows, however many records it has.
    """
    keys = list(keys)
    columns = list(spec.columns)
    lattice = query_lattice(
        tables.sparkSession, spec, orders, cat_options, cont_options, limit, seed
    )
    whole = limit is None or lattice_size(spec, orders, len(cat_options), len(cont_options)) <= limit
    if len(cat_options) == len(cont_options) == 1 and whole and len(columns) <= LATTICE_COLUMNS:
        counts = _superset_counts(
            tables, spec, targets, orders, cat_options[0], cont_options[0], keys, int_domain
        )
    else:
        renamed = targets.select(F.col(ID).alias("target_id"), *columns)
        counts = target_counts(tables, columns, lattice, renamed, keys, int_domain)
    names = lattice.select("query_id", "name")
    named = counts.select(*keys, "query_id", "cnt").join(broadcast_if_small(names), "query_id")
    return named.select(
        *keys,
        F.col("query_id").alias("feature_pos"),
        F.col("name").alias("feature"),
        F.col("cnt").cast("double").alias("value"),
    )


def _superset_counts(
    tables: DataFrame,
    spec: TableSpec,
    targets: DataFrame,
    orders: Sequence[int],
    cat_condition: int,
    cont_condition: int,
    keys: list[str],
    int_domain: bool,
) -> DataFrame:
    columns = list(spec.columns)
    literals = targets.select(
        F.col(ID).alias("target_id"),
        *[comparable(c, int_domain).alias(f"__t{i}") for i, c in enumerate(columns)],
    )
    asked = tables.join(broadcast_if_small(literals), "target_id")
    compare = {
        1: lambda x, t: x == t,
        -1: lambda x, t: x != t,
        2: lambda x, t: x > t,
        3: lambda x, t: x >= t,
        -2: lambda x, t: x < t,
        -3: lambda x, t: x <= t,
    }
    mask = F.lit(0)
    for i, c in enumerate(columns):
        condition = cat_condition if c in spec.categorical else cont_condition
        hit = compare[condition](comparable(c, int_domain), F.col(f"__t{i}"))
        mask = mask + F.coalesce(hit, F.lit(False)).cast("int") * F.lit(1 << i)
    counted = asked.select(*keys, mask.alias("mask")).groupBy(*keys, "mask").count()
    k = len(columns)
    wanted = np.array([q for q in range(1 << k) if q.bit_count() in set(orders)], dtype="int64")
    n_keys = len(keys)

    def superset_sums(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        totals = np.zeros(1 << k, dtype="int64")
        totals[group["mask"].to_numpy()] = group["count"].to_numpy()
        for i in range(k):
            halves = totals.reshape(-1, 2, 1 << i)
            halves[:, 0, :] += halves[:, 1, :]
        out = {keys[i]: key[i] for i in range(n_keys)}
        return pd.DataFrame({**out, "query_id": wanted, "cnt": totals[wanted]})

    types = dict(tables.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keys) + ", query_id bigint, cnt bigint"
    return counted.groupBy(*keys).applyInPandas(superset_sums, schema)


def _similarities(
    tables: DataFrame, spec: TableSpec, targets: DataFrame, keys: Sequence[str]
) -> DataFrame:
    renamed = targets.select(
        F.col(ID).alias("target_id"), *[F.col(f"`{c}`").alias(f"__t_{c}") for c in spec.columns]
    )
    beside = tables.join(broadcast_if_small(renamed), "target_id")
    return beside.withColumn("similarity", record_similarity(spec, "__t_")).select(
        *keys, ID, *spec.columns, "similarity"
    )


def similarity_features(
    tables: DataFrame, spec: TableSpec, targets: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Sorted similarities to the target as features ``distance_X=rank``."""
    ranked = distance_features(_similarities(tables, spec, targets, keys), keys)
    return ranked.select(
        *keys,
        F.col("rank").alias("feature_pos"),
        F.concat(F.lit("distance_X="), "rank").alias("feature"),
        F.col("similarity").alias("value"),
    )


def closest_features(
    tables: DataFrame, spec: TableSpec, targets: DataFrame, x: int = 50, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Column values (continuous, then one-hot) of the x most similar rows as features."""
    rows = closest_rows(_similarities(tables, spec, targets, keys), keys, x)
    cells = [(c, F.col(f"`{c}`").cast("double")) for c in spec.continuous]
    for c in spec.categorical:
        text = F.col(f"`{c}`").cast("string")
        cells += [(f"{c}_{v}", (text == str(v)).cast("double")) for v in spec.domain[c]]
    width = len(cells)
    entries = F.array(
        *[
            F.struct(
                (F.col("rank") * width + i).alias("feature_pos"),
                F.concat(F.lit(f"{name}_top_X="), F.col("rank")).alias("feature"),
                value.alias("value"),
            )
            for i, (name, value) in enumerate(cells)
        ]
    )
    return rows.select(*keys, F.explode(entries).alias("f")).select(*keys, "f.*")


EXTRACTORS = {
    "naive": lambda t, s, r, keys: naive_features(t, s, keys),
    "correlation": lambda t, s, r, keys: correlation_features(t, s, keys),
    "closest_X_full": lambda t, s, r, keys: closest_features(t, s, r, keys=keys),
    "all_distances": lambda t, s, r, keys: similarity_features(t, s, r, keys),
}


def extract_features(
    tables: DataFrame,
    spec: TableSpec,
    targets: DataFrame,
    extractors: Sequence,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Concatenate the features of the named extractors -> keys, extractor, feature_pos, ...

    An extractor is a name, ``("query", orders, number, cat options[, continuous options])``, or a
    function ``(tables, spec, targets, keys) -> long features``. Positions of a later extractor
    come after those of an earlier one: order by (extractor, feature_pos).
    """
    parts = []
    for place, extractor in enumerate(extractors):
        if callable(extractor):
            part = extractor(tables, spec, targets, keys)
        elif isinstance(extractor, str):
            if extractor not in EXTRACTORS:
                raise ValueError(f"unknown feature extractor {extractor!r}")
            part = EXTRACTORS[extractor](tables, spec, targets, keys)
        elif extractor[0] == "query":
            _, orders, number, cat_options, *rest = extractor
            cont_options = rest[0] if rest else (3,)
            part = query_features(
                tables, spec, targets, orders, cat_options, cont_options, number, keys=keys
            )
        else:
            raise ValueError(f"unknown feature extractor {extractor!r}")
        parts.append(part.withColumn("extractor", F.lit(place)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(*keys, "extractor", "feature_pos", "feature", "value")


def _feature_key(df: DataFrame, groups: Sequence[str]) -> list[str]:
    """What tells features apart: the extractor's number and the position where they are known, else the name."""
    if {"extractor", "feature_pos"} <= set(df.columns):
        return [*groups, "extractor", "feature_pos"]
    return [*groups, "feature"]


def drop_zero_features(
    train: DataFrame, test: DataFrame, groups: Sequence[str] = ("target_id",)
) -> tuple[DataFrame, DataFrame]:
    """Drop features whose sum over the train datasets is 0 (cancelling signs included)."""
    features = _feature_key(train, groups)
    kept = train.groupBy(*features).agg(F.sum("value").alias("s")).filter("s <> 0").select(*features)
    return train.join(kept, features, "left_semi"), test.join(kept, features, "left_semi")


def standardize_features(
    train: DataFrame, test: DataFrame, groups: Sequence[str] = ("target_id",)
) -> tuple[DataFrame, DataFrame]:
    """Centre and scale by the train mean and population deviation (0 -> 1)."""
    features = _feature_key(train, groups)
    sd = F.stddev_pop("value")
    fitted = train.groupBy(*features).agg(
        F.avg("value").alias("__mean"), F.when(sd == 0, 1.0).otherwise(sd).alias("__sd")
    )

    def apply(df: DataFrame) -> DataFrame:
        scaled = (F.col("value") - F.col("__mean")) / F.col("__sd")
        return df.join(fitted, features).withColumn("value", scaled).select(*df.columns)

    return apply(train), apply(test)


def feature_vectors(features: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per dataset with its feature values in position order -> keys, features (array).

    A row holds one dataset's features, so its length is the number of features.
    """
    order = ["extractor", "feature_pos"] if "extractor" in features.columns else ["feature_pos"]
    entry = F.struct(*order, "value")
    packed = features.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    return packed.select(*keys, F.transform("entries", lambda e: e["value"]).alias("features"))
