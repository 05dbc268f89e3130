"""DuckDB SQL twins of the registered queries, over the same tables.

The integer mix is written out in BIGINT arithmetic, so samples and noise come out equal.
"""

from __future__ import annotations

from tablerisk.functions.keyed import MASK32, MIX_FACTOR, mix_int
from tablerisk.functions.keyed import (
    STREAM_BIT,
    STREAM_DRAW_HIGH,
    STREAM_DRAW_LOW,
    STREAM_INDEX,
    STREAM_LAPLACE,
    STREAM_NORMAL_1,
    STREAM_NORMAL_2,
    STREAM_QUERY,
    STREAM_RANK,
    STREAM_STICKY,
    STREAM_SYNTH,
)
from tablerisk.operators.sampling import ROUNDS
from tablerisk.registry.queries import PROBES

ORACLE: dict[str, str] = {}


def mix(x: str) -> str:
    """The integer mix of one BIGINT expression."""
    x = f"({x})"
    for _ in range(2):
        x = f"((xor({x} >> 16, {x}) * {MIX_FACTOR}) & {MASK32})"
    return f"xor({x} >> 16, {x})"


def hash1(seed: int, key: str, stream: int) -> str:
    """Hash of one key column."""
    level = mix(f"({key} + {mix_int(seed + 1) + 1}) & {MASK32}")
    return mix(f"({level} + {stream}) & {MASK32}")


def fold(state: str | int, key: str) -> str:
    return mix(f"({state} + {key} + 1) & {MASK32}")


def staged(
    source: str, seed: int, keys: list[str], streams: dict[str, int], prefix: str = "g"
) -> str:
    """SELECT source.* plus one hash per stream, folding the keys one subquery at a time."""
    inner, state = source, str(mix_int(seed + 1))
    for i, key in enumerate(keys):
        inner = f"(SELECT *, {fold(state, key)} AS {prefix}{i} FROM {inner})"
        state = f"{prefix}{i}"
    named = ", ".join(f"{mix(f'({state} + {s}) & {MASK32}')} AS {n}" for n, s in streams.items())
    drop = ", ".join(f"{prefix}{i}" for i in range(len(keys)))
    return f"(SELECT * EXCLUDE ({drop}), {named} FROM {inner})"


def u(h: str) -> str:
    return f"(({h} + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


def codes(table: str, column: str, name: str) -> str:
    """CTE ``name`` (v, code): ordinal codes of a column."""
    return (
        f"{name} AS (SELECT v, (row_number() OVER (ORDER BY v) - 1)::BIGINT AS code "
        f"FROM (SELECT DISTINCT {column} AS v FROM {table}))"
    )


CUSTOMERS = f"""{codes('customer', 'c_mktsegment', 'seg')},
cust AS (SELECT c_custkey AS record_id, c_nationkey::BIGINT AS c_nationkey,
  seg.code AS c_mktsegment, floor(c_acctbal / 1000.0)::BIGINT AS band
  FROM customer JOIN seg ON c_mktsegment = seg.v)"""

ORDERS = f"""{codes('orders', 'o_orderstatus', 'sta')}, {codes('orders', 'o_orderpriority', 'pri')},
ord AS (SELECT o_orderkey AS record_id, sta.code AS o_orderstatus, pri.code AS o_orderpriority,
  floor(o_totalprice / 10000.0)::BIGINT AS band, o_custkey
  FROM orders JOIN sta ON o_orderstatus = sta.v JOIN pri ON o_orderpriority = pri.v)"""

EVENTS = f"""{codes('events', 'event_type', 'typ')},
ev AS (SELECT 0::BIGINT AS target_id, user_id % 20 AS dataset_id, event_id AS record_id,
  typ.code AS event_type, value, hour(ts)::DOUBLE AS hour FROM events JOIN typ ON event_type = typ.v)"""

PART = """prt AS (SELECT p_partkey AS record_id, coalesce(p_brand, 'nan') AS p_brand,
  coalesce(p_type, 'nan') AS p_type, p_size::DOUBLE AS p_size, p_retailprice::DOUBLE AS p_retailprice
  FROM part)"""

PREPARED = f"""{PART}, {codes('prt', 'p_brand', 'bra')}, {codes('prt', 'p_type', 'tpe')},
prep AS (SELECT record_id, bra.code AS p_brand, tpe.code AS p_type, p_size,
  (p_retailprice - (SELECT min(p_retailprice) FROM prt))
  / nullif((SELECT max(p_retailprice) - min(p_retailprice) FROM prt), 0) AS p_retailprice
  FROM prt JOIN bra ON p_brand = bra.v JOIN tpe ON p_type = tpe.v)"""

SCORES = f"""{PREPARED},
unit AS (SELECT *, sqrt(p_size * p_size + p_retailprice * p_retailprice) AS norm FROM prep),
pairs AS (SELECT a.record_id,
  (2 - (a.p_brand = b.p_brand)::INT - (a.p_type = b.p_type)::INT) / 4.0::DOUBLE
  + 0.5::DOUBLE * (1.0::DOUBLE - CASE WHEN a.norm > 0 AND b.norm > 0
    THEN (a.p_size / a.norm) * (b.p_size / b.norm)
       + (a.p_retailprice / a.norm) * (b.p_retailprice / b.norm) ELSE 0 END) AS d
  FROM unit a, unit b),
ranked AS (SELECT record_id, d, row_number() OVER (PARTITION BY record_id ORDER BY d) AS place FROM pairs),
scores AS (SELECT record_id, round(greatest(avg(d), 0), 9) AS achilles_score FROM ranked
  WHERE place <= 5 GROUP BY record_id)"""


def half_filter(seed: int, bit: int, key: str = "record_id") -> str:
    return f"({hash1(seed, key, 3)} & 1) = {bit}"


def sampled(name: str, pool: str, frames: str, seed: int) -> str:
    """CTEs ending in ``name`` (frame columns + record_id): places under a keyed permutation.

    ``frames`` is a CTE with dataset_id and wanted.
    """
    streams = {f"high{r}": STREAM_DRAW_HIGH + 1000 * r for r in range(ROUNDS)}
    streams |= {f"low{r}": STREAM_DRAW_LOW + 1000 * r for r in range(ROUNDS)}
    place = f"(SELECT *, unnest(range(0, wanted)) AS x FROM {name}_keys)"
    for r in range(ROUNDS):
        key = (f"floor((high{r} * 2097152 + (low{r} >> 11))::DOUBLE / 9007199254740992.0::DOUBLE"
               f" * total::DOUBLE)::BIGINT")
        pair = f"(SELECT *, ({key} - x + total) % total AS p FROM {place})"
        turned = f"(SELECT *, (greatest(x, p) + low{r} + 1) & {MASK32} AS f FROM {pair})"
        place = f"(SELECT * EXCLUDE (p, f) REPLACE (CASE WHEN ({mix('f')} & 1) = 1 THEN p ELSE x END AS x) FROM {turned})"
    return f"""{name}_keys AS (SELECT * FROM {staged(frames, seed, ["dataset_id"], streams)},
  (SELECT count(*)::BIGINT AS total FROM {pool})),
{name}_index AS (SELECT record_id AS rid, (row_number() OVER (ORDER BY h, record_id) - 1)::BIGINT AS pos
  FROM (SELECT record_id, {hash1(seed, 'record_id', STREAM_INDEX)} AS h FROM {pool})),
{name} AS (SELECT dataset_id, rid AS record_id FROM (SELECT dataset_id, x AS pos FROM {place}) JOIN {name}_index USING (pos))"""


def bits(source: str, seed: int) -> str:
    """source.* plus h, the sensitive-bit hash of (dataset_id, record_id)."""
    return staged(source, seed, ["dataset_id", "record_id"], {"h": STREAM_BIT}, "k")


# ---- tables -------------------------------------------------------------------------------

ORACLE["load_table"] = f"WITH {PART} SELECT * FROM prt"
ORACLE["select_columns"] = f"WITH {PART} SELECT record_id, p_type, p_size FROM prt"
ORACLE["target_record"] = f"WITH {PART} SELECT * FROM prt WHERE record_id = 7"
ORACLE["prepare_table"] = f"""WITH {PREPARED}
SELECT record_id, p_brand, p_type, round(p_size, 6) AS p_size,
  round(p_retailprice, 6) AS p_retailprice FROM prep"""
ORACLE["ingest_discretized"] = f"""WITH {codes('customer', 'c_nationkey', 'nat')},
{codes('customer', 'c_mktsegment', 'seg')}, {codes('customer', 'c_acctbal', 'bal')}
SELECT c_custkey AS record_id, nat.code AS c_nationkey, seg.code AS c_mktsegment,
  bal.code AS c_acctbal FROM customer JOIN nat ON c_nationkey = nat.v
  JOIN seg ON c_mktsegment = seg.v JOIN bal ON c_acctbal = bal.v"""
ORACLE["discretize"] = f"""WITH {PART}, {codes('prt', 'p_brand', 'bra')}, {codes('prt', 'p_type', 'tpe')}
SELECT record_id, bra.code AS p_brand, tpe.code AS p_type, round(p_size, 6) AS p_size,
  round(p_retailprice, 6) AS p_retailprice
FROM prt JOIN bra ON p_brand = bra.v JOIN tpe ON p_type = tpe.v"""
ORACLE["minmax_normalize"] = f"""WITH {PART},
ref AS (SELECT min(p_size) AS a, max(p_size) AS b, min(p_retailprice) AS c, max(p_retailprice) AS d
  FROM prt WHERE {half_filter(1, 0)})
SELECT record_id, p_brand, p_type, round((p_size - a) / nullif(b - a, 0), 6) AS p_size,
  round((p_retailprice - c) / nullif(d - c, 0), 6) AS p_retailprice FROM prt, ref"""
_FLAGS = ", ".join(
    [f"(o_orderstatus = '{v}')::BIGINT AS o_orderstatus_{v}" for v in "FOP"]
    + [f"(o_orderpriority[1] = '{v}')::BIGINT AS o_orderpriority_{v}" for v in "12345"]
)
ORACLE["one_hot"] = f"""SELECT o_orderkey AS record_id, round(o_totalprice, 6) AS o_totalprice, {_FLAGS}
FROM orders"""
ORACLE["split_table"] = f"""WITH {CUSTOMERS},
turn AS (SELECT *, {hash1(2, 'record_id', 3)} % 3 AS t FROM cust)
SELECT * EXCLUDE (t), 'aux' AS split FROM turn WHERE t = 0
UNION ALL SELECT * EXCLUDE (t), 'target' FROM turn WHERE t = 1
UNION ALL SELECT * EXCLUDE (t), 'eval' FROM turn WHERE t <> 0"""


def random_split(seed: int, test: str, aux: str) -> str:
    return f"""(SELECT * EXCLUDE (h, r), CASE WHEN r < {test} THEN 'test' ELSE 'aux' END AS split
FROM (SELECT *, row_number() OVER (ORDER BY h, record_id) - 1 AS r
  FROM (SELECT *, {hash1(seed, 'record_id', STREAM_RANK)} AS h FROM cust))
WHERE r < {test} + {aux})"""


_N = "(SELECT count(*) FROM customer)"
ORACLE["random_split"] = f"WITH {CUSTOMERS} SELECT * FROM {random_split(9, f'{_N} // 5', f'{_N} // 2')}"
_HALVED = "CASE WHEN row_number() OVER (ORDER BY record_id) <= count(*) OVER () // 2 THEN 'train' ELSE 'eval' END AS pool"
ORACLE["halve_pool"] = f"WITH {CUSTOMERS} SELECT *, {_HALVED} FROM cust"
ORACLE["halve_pool_large_ids"] = f"""WITH {CUSTOMERS}
SELECT * REPLACE (record_id + {2**60} AS record_id), {_HALVED} FROM cust"""
ORACLE["discretize_large_values"] = f"""WITH big AS (SELECT o_orderkey AS record_id, o_custkey + {2**60} AS owner,
  o_totalprice AS price FROM orders), {codes('big', 'owner', 'own')}, {codes('big', 'price', 'pri')}
SELECT record_id, own.code AS owner, pri.code AS price FROM big JOIN own ON owner = own.v JOIN pri ON price = pri.v"""
LINES = f"""{codes('lineitem', 'l_returnflag', 'fla')}, {codes('lineitem', 'l_linestatus', 'lst')},
lin AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, fla.code AS l_returnflag,
  lst.code AS l_linestatus, l_quantity, l_discount
  FROM lineitem JOIN fla ON l_returnflag = fla.v JOIN lst ON l_linestatus = lst.v)"""
ORACLE["exclude_identical"] = f"""WITH {LINES},
t AS (SELECT * FROM lin WHERE l_linenumber = 7)
SELECT lin.* REPLACE (round(lin.l_quantity, 6) AS l_quantity, round(lin.l_discount, 6) AS l_discount)
FROM lin WHERE NOT EXISTS (SELECT 1 FROM t WHERE lin.l_returnflag IS NOT DISTINCT FROM t.l_returnflag
  AND lin.l_linestatus IS NOT DISTINCT FROM t.l_linestatus AND lin.l_quantity IS NOT DISTINCT FROM t.l_quantity
  AND lin.l_discount IS NOT DISTINCT FROM t.l_discount)"""
ORACLE["unique_records"] = """SELECT min(l_orderkey * 8 + l_linenumber) AS record_id FROM lineitem
GROUP BY l_suppkey, l_returnflag, l_quantity, l_discount HAVING count(*) = 1"""

# ---- sampling and shadow tables -----------------------------------------------------------


def numbers(n: int) -> str:
    return f"(SELECT unnest(range(0, {n})) AS dataset_id)"


ORACLE["sample_per_dataset"] = f"""WITH {CUSTOMERS},
frames AS (SELECT dataset_id, {_N} // 10 AS wanted FROM {numbers(8)}),
{sampled('drawn', 'cust', 'frames', 4)}
SELECT dataset_id, cust.* FROM drawn JOIN cust USING (record_id)"""
ORACLE["randomize_sensitive"] = f"""WITH {CUSTOMERS}
SELECT * EXCLUDE (h), h & 1 AS sensitive FROM {bits(f'(SELECT * FROM cust, {numbers(8)})', 6)}"""
FIXED = f"""fixed AS (SELECT * EXCLUDE (h, dataset_id), h & 1 AS sensitive
  FROM {bits(f'(SELECT * FROM cust, {numbers(1)})', 8)})"""
ORACLE["exact_shadow"] = f"""WITH {CUSTOMERS}, {FIXED}
SELECT * EXCLUDE (h) REPLACE (CASE WHEN record_id = 5 THEN h & 1 ELSE sensitive END AS sensitive)
FROM {bits(f'(SELECT * FROM fixed, {numbers(8)})', 6)}"""


def shadow(pool: str, targets: str, n: str, n_datasets: int, seed: int) -> str:
    """CTEs ending in ``shadows`` (target_id, dataset_id, in_dataset, record_id)."""
    return f"""chosen AS (SELECT record_id AS target_id,
  (row_number() OVER (ORDER BY record_id) - 1) AS number FROM {targets}),
frames AS (SELECT *, ({n}) - in_dataset::BIGINT AS wanted FROM (
  SELECT target_id, number * {n_datasets} + i AS dataset_id, i % 2 = 0 AS in_dataset
  FROM chosen, (SELECT unnest(range(0, {n_datasets})) AS i))),
{sampled('drawn', pool, 'frames', seed)},
shadows AS (SELECT target_id, dataset_id, in_dataset, record_id FROM drawn JOIN frames USING (dataset_id)
  UNION ALL SELECT target_id, dataset_id, in_dataset, target_id FROM frames WHERE in_dataset)"""


HALVES = f"""{CUSTOMERS}, aux AS (SELECT * FROM cust WHERE {half_filter(11, 1)}),
pool AS (SELECT * FROM cust WHERE {half_filter(11, 0)})"""
_SHADOW_OUT = "SELECT target_id, dataset_id, in_dataset, cust.* FROM shadows JOIN cust USING (record_id)"
ORACLE["shadow_tables"] = f"""WITH {HALVES},
{shadow('aux', '(SELECT min(record_id) AS record_id FROM pool GROUP BY c_nationkey)', f'{_N} // 20', 4, 12)} {_SHADOW_OUT}"""
ORACLE["shadow_tables_average"] = f"""WITH {HALVES},
targets AS (SELECT min(record_id) AS record_id FROM aux GROUP BY c_mktsegment),
others AS (SELECT * FROM pool WHERE record_id NOT IN (SELECT record_id FROM targets)),
{shadow('others', 'targets', f'{_N} // 20', 4, 14)} {_SHADOW_OUT}"""
ORACLE["shadow_tables_specific"] = f"""WITH {HALVES},
base AS (SELECT * FROM pool WHERE {half_filter(18, 1)}),
targets AS (SELECT record_id AS target_id, row_number() OVER (ORDER BY record_id) - 1 AS number
  FROM (SELECT min(record_id) AS record_id FROM base GROUP BY c_mktsegment)),
frames AS (SELECT target_id, number * 6 + i.dataset_id AS dataset_id, i.dataset_id % 2 = 0 AS in_dataset, 2 AS wanted
  FROM targets, {numbers(6)} i),
odd AS (SELECT dataset_id, wanted FROM frames WHERE NOT in_dataset),
{sampled('drawn', 'pool', 'odd', 13)},
refs AS (SELECT f.target_id, f.dataset_id, d.record_id FROM drawn d JOIN frames f USING (dataset_id)
  WHERE d.record_id <> f.target_id
  QUALIFY row_number() OVER (PARTITION BY f.target_id, f.dataset_id
    ORDER BY {hash1(13, 'd.record_id', STREAM_RANK)}, d.record_id) = 1),
every AS (SELECT f.target_id, f.dataset_id, f.in_dataset, b.record_id FROM base b, frames f WHERE b.record_id <> f.target_id
  UNION ALL SELECT target_id, dataset_id, false, record_id FROM refs
  UNION ALL SELECT target_id, dataset_id, true, target_id FROM frames WHERE in_dataset)
SELECT target_id, dataset_id, in_dataset, cust.* FROM every JOIN cust USING (record_id)"""
OTHERS = """target AS (SELECT * FROM cust WHERE record_id = 5),
others AS (SELECT c.record_id FROM cust c, target t WHERE c.c_nationkey <> t.c_nationkey
  OR c.c_mktsegment <> t.c_mktsegment OR c.band <> t.band)"""
ORACLE["target_dataset"] = f"""WITH {CUSTOMERS}, {OTHERS},
frames AS (SELECT dataset_id, {_N} // 10 - 1 AS wanted FROM {numbers(6)}),
{sampled('drawn', 'others', 'frames', 15)},
every AS (SELECT dataset_id, record_id, false AS is_target FROM drawn
  UNION ALL SELECT dataset_id, 5, true FROM {numbers(6)})
SELECT dataset_id, cust.*, h & 1 AS sensitive, is_target FROM {bits('every', 15)}
JOIN cust USING (record_id)"""


def auxiliary(n_datasets: int) -> str:
    """CTEs ending in ``auxs``."""
    n_train = n_datasets // 2
    size = f"{_N} // 20 - 1"
    return f"""{CUSTOMERS}, {OTHERS},
halved AS (SELECT record_id, row_number() OVER (ORDER BY record_id) <= count(*) OVER () // 2 AS first
  FROM others),
train_pool AS (SELECT record_id FROM halved WHERE first),
eval_pool AS (SELECT record_id FROM halved WHERE NOT first),
train_frames AS (SELECT dataset_id, {size} AS wanted FROM {numbers(n_datasets)} WHERE dataset_id < {n_train}),
eval_frames AS (SELECT dataset_id, {size} AS wanted FROM {numbers(n_datasets)} WHERE dataset_id >= {n_train}),
{sampled('train_drawn', 'train_pool', 'train_frames', 16)},
{sampled('eval_drawn', 'eval_pool', 'eval_frames', 16)},
members AS (SELECT dataset_id, record_id, false AS is_target FROM train_drawn
  UNION ALL SELECT dataset_id, record_id, false FROM eval_drawn
  UNION ALL SELECT dataset_id, 5, true FROM {numbers(n_datasets)}),
auxs AS (SELECT CASE WHEN dataset_id < {n_train} THEN 'train' ELSE 'eval' END AS phase, dataset_id,
  cust.*, h & 1 AS sensitive, is_target FROM {bits('members', 16)} JOIN cust USING (record_id))"""


ORACLE["auxiliary_shadow"] = f"WITH {auxiliary(8)} SELECT * FROM auxs"
ORACLE["shadow_summary"] = f"""WITH {auxiliary(8)}
SELECT dataset_id, count(*) AS n_rows,
  least(floor(count(*) FILTER (record_id < 5) * 10 / count(*)), 9)::BIGINT AS target_position_bin,
  max(sensitive) FILTER (record_id = 5) AS label FROM auxs GROUP BY dataset_id"""

# ---- nearest neighbours -------------------------------------------------------------------

ORACLE["achilles_scores"] = f"WITH {SCORES} SELECT record_id, round(achilles_score, 6) AS achilles_score FROM scores"
ORACLE["top_vulnerable"] = f"""WITH {SCORES}
SELECT record_id, round(achilles_score, 6) AS achilles_score,
  row_number() OVER (ORDER BY achilles_score DESC, record_id) AS rank
FROM scores QUALIFY rank <= 100"""
ORACLE["score_summary"] = f"""WITH {SCORES}
SELECT round(avg(achilles_score), 6) AS mean_score,
  round(quantile_cont(achilles_score, 0.75), 6) AS q3,
  round(100.0 * count(*) FILTER (achilles_score < (SELECT avg(achilles_score) FROM scores)) / count(*), 6)
    AS pct_below_mean FROM scores"""
ORACLE["score_histogram"] = f"""WITH {SCORES},
cut AS (SELECT min(achilles_score) AS threshold FROM
  (SELECT achilles_score FROM scores ORDER BY achilles_score DESC LIMIT 100)),
ends AS (SELECT min(achilles_score) AS low, max(achilles_score) AS high, count(*) AS total FROM scores)
SELECT least(floor(coalesce((achilles_score - low) / nullif(high - low, 0), 0) * 20), 19)::BIGINT AS bin,
  CASE WHEN achilles_score < threshold THEN 'Low' ELSE 'High' END AS label,
  round(count(*) / any_value(total), 6) AS probability
FROM scores, cut, ends GROUP BY ALL"""
ORACLE["vulnerability_report"] = f"""WITH {SCORES}
SELECT row_number() OVER (ORDER BY achilles_score DESC, record_id) AS rank,
  round(achilles_score, 6) AS achilles_score FROM scores QUALIFY rank <= 50"""
SIMILARITY = """emb AS (SELECT vec_id AS record_id, label::BIGINT AS dataset_id, embedding::DOUBLE[] AS v
  FROM embeddings),
sim AS (SELECT e.dataset_id, e.record_id, round(coalesce(list_dot_product(e.v, t.v)
  / nullif(sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(t.v, t.v)), 0), 0), 9) AS similarity
  FROM emb e, (SELECT v FROM emb WHERE record_id = 0) t),
placed AS (SELECT *, (row_number() OVER (PARTITION BY dataset_id ORDER BY similarity DESC, record_id) - 1)
  ::BIGINT AS rank FROM sim)"""
ORACLE["distance_features"] = f"""WITH {SIMILARITY}
SELECT dataset_id, rank, round(similarity, 6) AS similarity FROM placed"""
ORACLE["closest_rows"] = f"""WITH {SIMILARITY}
SELECT dataset_id, record_id, rank, round(similarity, 6) AS similarity FROM placed WHERE rank < 50"""

# ---- count queries ------------------------------------------------------------------------


def digit(options: int, weight: int, i: int) -> str:
    return f"(query_id // {weight} % {options + 1})"


def lattice(columns: list[str], options: list[tuple], orders: list[int]) -> str:
    """CTE ``lat`` (query_id, c0, c1, ...): mixed-radix condition vectors of the given orders."""
    total, out = 1, []
    for i, choice in enumerate(options):
        place = digit(len(choice), total, i)
        cases = " ".join(f"WHEN {k + 1} THEN {v}" for k, v in enumerate(choice))
        out.append(f"CASE {place} {cases} ELSE 0 END AS c{i}")
        total *= len(choice) + 1
    order = " + ".join(f"(c{i} <> 0)::INT" for i in range(len(options)))
    wanted = ", ".join(map(str, orders))
    return f"""lat AS (SELECT * FROM (SELECT query_id, {', '.join(out)} FROM
  (SELECT unnest(range(0, {total})) AS query_id)) WHERE {order} IN ({wanted}))"""


def test(condition: str, x: str, v: str) -> str:
    return (
        f"CASE {condition} WHEN 0 THEN true WHEN 1 THEN {x} = {v} WHEN -1 THEN {x} <> {v} "
        f"WHEN 2 THEN {x} > {v} WHEN 3 THEN {x} >= {v} WHEN -2 THEN {x} < {v} "
        f"WHEN -3 THEN {x} <= {v} END"
    )


def matches(columns: list[str], row: str, value: str) -> str:
    return " AND ".join(
        test(f"c{i}", f"{row}.{c}", f"{value}.{c}") for i, c in enumerate(columns)
    )


_LINE = ["l_returnflag", "l_linestatus", "l_quantity", "l_discount"]
_CAT, _CONT = (1, -1), (2, 3, -2, -3)
ORACLE["count_queries"] = f"""WITH {LINES},
{lattice(_LINE, [_CAT, _CAT, _CONT, _CONT], [1, 2, 3, 4])},
vals AS (SELECT l_returnflag * 2 + l_linestatus AS value_id, l_returnflag, l_linestatus,
  floor(avg(l_quantity)) AS l_quantity, round(avg(l_discount), 2) AS l_discount
  FROM lin GROUP BY l_returnflag, l_linestatus),
few AS (SELECT {', '.join(_LINE)}, count(*) AS n FROM lin GROUP BY ALL)
SELECT value_id, query_id, coalesce(sum(n) FILTER ({matches(_LINE, 'few', 'vals')}), 0)::BIGINT AS cnt
FROM few, vals, lat GROUP BY value_id, query_id"""
_FULL = ["c_nationkey", "c_mktsegment", "band", "sensitive"]
ORACLE["structured_counts"] = f"""WITH {CUSTOMERS}, {FIXED},
{lattice(_FULL, [_CAT] * 4, [1, 2, 3, 4])},
vals AS (SELECT record_id AS user_id, * REPLACE (1 AS sensitive) FROM fixed)
SELECT user_id, query_id, count(*) FILTER ({matches(_FULL, 'fixed', 'vals')}) AS cnt
FROM fixed, vals, lat GROUP BY user_id, query_id"""
_ORD = ["o_orderstatus", "o_orderpriority", "band"]
_ORD_MATCH = matches(_ORD, "ord", "vals")
COUNTS = f"""{ORDERS}, {lattice(_ORD, [_CAT, _CAT, (1, 2, -2)], [1, 2, 3])},
vals AS (SELECT * FROM ord WHERE record_id = 0),
hashed AS (SELECT *, {mix('record_id + 1')} AS user_hash FROM ord),
cnts AS (SELECT query_id, count(*) FILTER ({_ORD_MATCH.replace('ord.', 'hashed.')}) AS cnt,
  coalesce(bit_xor(user_hash) FILTER ({_ORD_MATCH.replace('ord.', 'hashed.')}), 0) AS set_hash
  FROM hashed, vals, lat GROUP BY query_id)"""


def noised(answer: str) -> str:
    return f"greatest(round({answer}), 0)::BIGINT AS answer"


ORACLE["user_set_hash"] = f"WITH {COUNTS} SELECT query_id, cnt, set_hash FROM cnts"
_NORMAL = f"sqrt(-2.0::DOUBLE * ln({u('h1')})) * cos(2 * pi() * {u('h2')})"
ORACLE["counts_threshold_gaussian"] = f"""WITH {COUNTS}
SELECT query_id, {noised(f'CASE WHEN cnt <= 20 THEN 0 ELSE cnt + 3.0::DOUBLE * {_NORMAL} END')}
FROM {staged('cnts', 21, ['query_id'], {'h1': STREAM_NORMAL_1, 'h2': STREAM_NORMAL_2})}"""


def sticky(source: str, seed: int, keep: str) -> str:
    keyed = f"(SELECT *, xor(set_hash, {mix_int(seed + 1)}) AS user_set FROM {source})"
    noisy = f"CASE WHEN cnt <= 4 THEN 0 ELSE cnt + floor({u('h')} * 5) - 2 END"
    return f"SELECT {keep}, {noised(noisy)} FROM {staged(keyed, seed, ['user_set'], {'h': STREAM_STICKY})}"


ORACLE["counts_sticky_uniform"] = f"WITH {COUNTS} {sticky('cnts', 22, 'query_id')}"
_LAP = f"-sign({u('h')} - 0.5) * ln(1.0::DOUBLE - 2.0::DOUBLE * abs({u('h')} - 0.5))"
ORACLE["counts_dp_laplace"] = f"""WITH {COUNTS}
SELECT query_id, {noised(f'cnt + ({_LAP}) / ((1.0::DOUBLE / (query_id % 4 + 1)) * 0.5)')}
FROM {staged('cnts', 23, ['query_id'], {'h': STREAM_LAPLACE})}"""
_NAME = "concat_ws('_', " + ", ".join(
    f"CASE WHEN c{i} <> 0 THEN c{i} || '_{c}' END" for i, c in enumerate(_ORD)
) + ")"
ORACLE["query_lattice"] = f"""WITH {COUNTS},
picked AS (SELECT * FROM {staged('lat', 42, ['query_id'], {'h': STREAM_QUERY})} ORDER BY h, query_id LIMIT 30)
SELECT query_id, {_NAME} AS name, concat_ws(',', c0, c1, c2) AS conditions, cnt
FROM picked JOIN cnts USING (query_id)"""
_LOG_HASH = staged(
    "(SELECT event_id AS query_id, user_id % 10 AS solution_id FROM events)",
    17,
    ["query_id"],
    {f"h{i}": STREAM_QUERY + i for i in range(6)},
)
LOG = f"""lg AS (SELECT query_id, solution_id, {', '.join(f'h{i} % 3 - 1 AS c{i}' for i in range(6))}
  FROM {_LOG_HASH}),
logs AS (SELECT *, concat_ws(',', c0, c1, c2, c3, c4, c5) AS conditions FROM lg)"""
_N_COND = " + ".join(f"(c{i} <> 0)::INT" for i in range(6))
ORACLE["query_multiplicity"] = f"""WITH {LOG}
SELECT conditions, count(*) AS multiplicity, any_value({_N_COND})::BIGINT AS n_conditions
FROM logs GROUP BY conditions"""
ORACLE["query_occurrences"] = f"""WITH {LOG}
SELECT query_id, solution_id, conditions,
  row_number() OVER (PARTITION BY solution_id, conditions ORDER BY query_id) - 1 AS occurrence FROM logs"""
ORACLE["budget_shares"] = f"""WITH {LOG}
SELECT solution_id, conditions, round(count(*) / sum(count(*)) OVER (PARTITION BY solution_id), 9) AS budget
FROM logs GROUP BY solution_id, conditions"""
_DIFF = " + ".join(f"(a.c{i} <> b.c{i})::INT" for i in range(6))
_SPOT = " + ".join(f"{i} * (a.c{i} = 0 AND b.c{i} = -1)::INT" for i in range(5))
_ZERO_TO_NEG = " OR ".join(f"(a.c{i} = 0 AND b.c{i} = -1)" for i in range(5))
_NO_NEG = " AND ".join(f"a.c{i} <> -1" for i in range(5))
PAIRS = f"""{LOG}, dq AS (SELECT DISTINCT conditions, c0, c1, c2, c3, c4, c5 FROM logs),
prs AS (SELECT a.conditions AS leading, b.conditions AS partner, ({_SPOT})::BIGINT AS position
  FROM dq a, dq b WHERE a.c5 <> 0 AND {_NO_NEG} AND ({_DIFF}) = 1 AND ({_ZERO_TO_NEG}))"""
ORACLE["difference_query_pairs"] = f"WITH {PAIRS} SELECT * FROM prs"
ORACLE["unpaired_queries"] = f"""WITH {PAIRS} SELECT conditions FROM dq
WHERE conditions NOT IN (SELECT "leading" FROM prs UNION SELECT partner FROM prs)"""

# ---- features -----------------------------------------------------------------------------

_EV = ["event_type", "value", "hour"]


def event_counts(options: list[tuple], orders: list[int], target: str) -> str:
    """CTEs ending in ``feats``; values are truncated to integers before comparing."""
    name = "concat_ws('_', " + ", ".join(
        f"CASE WHEN c{i} <> 0 THEN c{i} || '_{c}' END" for i, c in enumerate(_EV)
    ) + ")"
    return f"""{EVENTS}, {lattice(_EV, options, orders)},
evi AS (SELECT target_id, dataset_id, event_type, trunc(value)::BIGINT AS value, hour::BIGINT AS hour FROM ev),
tgt AS ({target}),
feats AS (SELECT evi.target_id, dataset_id, query_id AS feature_pos, any_value({name}) AS feature,
  (count(*) FILTER ({matches(_EV, 'evi', 'tgt')}))::DOUBLE AS value
  FROM evi, tgt, lat GROUP BY evi.target_id, dataset_id, query_id)"""


_FIRST = "SELECT event_type, trunc(value)::BIGINT AS value, hour::BIGINT AS hour FROM ev WHERE record_id = 0"
_FEATURES = event_counts([(1,), (3,), (3,)], [1, 2, 3], _FIRST)
ORACLE["query_features"] = f"WITH {_FEATURES} SELECT * FROM feats"
ORACLE["query_features_sparse"] = (
    f"WITH {event_counts([(1, -1), (2, -3), (2, -3)], [1, 2], _FIRST)} SELECT * FROM feats"
)


def naive() -> str:
    """SELECT of the naive features from ev."""
    rows = [
        ("mean_value", "avg(value)"),
        ("mean_hour", "avg(hour)"),
        ("median_value", "median(value)"),
        ("median_hour", "median(hour)"),
        ("var_value", "var_pop(value)"),
        ("var_hour", "var_pop(hour)"),
    ]
    parts = [
        f"SELECT target_id, dataset_id, {i}::BIGINT AS feature_pos, '{n}' AS feature, {e} AS value "
        f"FROM ev GROUP BY target_id, dataset_id"
        for i, (n, e) in enumerate(rows)
    ]
    grid = """(SELECT g.target_id, g.dataset_id, d.code, count(ev.record_id) AS n
  FROM (SELECT DISTINCT target_id, dataset_id FROM ev) g CROSS JOIN (SELECT unnest(range(0, 6)) AS code) d
  LEFT JOIN ev ON ev.target_id = g.target_id AND ev.dataset_id = g.dataset_id AND ev.event_type = d.code
  GROUP BY ALL)"""
    for i, (n, e) in enumerate(
        [
            ("event_type_distinct", "count(*) FILTER (n > 0)"),
            ("event_type_most_freq", "arg_max(code, n * 100 - code)"),
            ("event_type_least_freq", "arg_min(code, n * 100 + code)"),
        ]
    ):
        parts.append(
            f"SELECT target_id, dataset_id, {6 + i}::BIGINT, '{n}', ({e})::DOUBLE FROM {grid} "
            f"GROUP BY target_id, dataset_id"
        )
    return " UNION ALL ".join(parts)


def correlation() -> str:
    columns = ["value", "hour"] + [f"(event_type = {v})::INT" for v in range(6)]
    parts, position = [], 0
    for i in range(8):
        for j in range(i + 1, 8):
            a, b = columns[i], columns[j]
            value = (
                f"CASE WHEN min({a}) = max({a}) OR min({b}) = max({b}) THEN 0 ELSE corr({a}, {b}) END"
            )
            parts.append(
                f"SELECT target_id, dataset_id, {position}::BIGINT AS feature_pos, "
                f"'corr_{position}' AS feature, {value} AS value FROM ev GROUP BY target_id, dataset_id"
            )
            position += 1
    return " UNION ALL ".join(parts)


_ROUND = "SELECT * REPLACE (round(value, 6) AS value)"
ORACLE["naive_features"] = f"WITH {EVENTS} {_ROUND} FROM ({naive()})"
ORACLE["correlation_features"] = f"WITH {EVENTS} {_ROUND} FROM ({correlation()})"
_COS = """coalesce((ev.value * t.value + ev.hour * t.hour + (ev.event_type = t.event_type)::DOUBLE)
  / nullif(sqrt(1 + ev.value * ev.value + ev.hour * ev.hour)
  * sqrt(1 + t.value * t.value + t.hour * t.hour), 0), 0)"""
ORACLE["similarity_features"] = f"""WITH {EVENTS},
sims AS (SELECT ev.target_id, ev.dataset_id, {_COS} AS s FROM ev, (SELECT * FROM ev WHERE record_id = 0) t),
rks AS (SELECT *, (row_number() OVER (PARTITION BY target_id, dataset_id ORDER BY s DESC) - 1)::BIGINT AS r
  FROM sims)
SELECT target_id, dataset_id, r AS feature_pos, 'distance_X=' || r AS feature, round(s, 5) AS value FROM rks"""
_CLOSE = "".join(
    f" UNION ALL SELECT target_id, dataset_id, r * 8 + {2 + v}, 'event_type_{v}_top_X=' || r, "
    f"(event_type = {v})::DOUBLE FROM top"
    for v in range(6)
)
ORACLE["closest_features"] = f"""WITH {EVENTS},
sims AS (SELECT ev.*, {_COS} AS s FROM ev, (SELECT * FROM ev WHERE record_id = 0) t),
top AS (SELECT *, (row_number() OVER (PARTITION BY target_id, dataset_id ORDER BY s DESC, record_id) - 1)
  ::BIGINT AS r FROM sims QUALIFY r < 10)
SELECT target_id, dataset_id, r * 8 AS feature_pos, 'value_top_X=' || r AS feature, round(value, 6) AS value FROM top
UNION ALL SELECT target_id, dataset_id, r * 8 + 1, 'hour_top_X=' || r, hour FROM top{_CLOSE}"""
ORACLE["extract_features"] = f"""WITH {_FEATURES},
every AS (SELECT *, 0::BIGINT AS extractor FROM ({naive()})
  UNION ALL SELECT *, 1 FROM feats UNION ALL SELECT *, 2 FROM ({correlation()}))
{_ROUND} FROM every"""
_TOP = "SELECT 0 AS event_type, trunc(max(value))::BIGINT AS value, max(hour)::BIGINT AS hour FROM ev"
_SPLIT = f"""{event_counts([(1, -1), (2, -3), (2, -3)], [1, 2], _TOP)},
phased AS (SELECT *, CASE WHEN dataset_id < 10 THEN 'train' ELSE 'eval' END AS phase FROM feats)"""
ORACLE["drop_zero_features"] = f"""WITH {_SPLIT} SELECT * FROM phased WHERE (target_id, feature) IN
(SELECT (target_id, feature) FROM phased WHERE phase = 'train' GROUP BY target_id, feature HAVING sum(value) <> 0)"""
ORACLE["standardize_features"] = f"""WITH {_SPLIT},
fit AS (SELECT target_id, feature, avg(value) AS m,
  CASE WHEN stddev_pop(value) = 0 THEN 1 ELSE stddev_pop(value) END AS s
  FROM phased WHERE phase = 'train' GROUP BY target_id, feature)
SELECT target_id, dataset_id, feature_pos, feature, round((value - m) / s, 6) AS value, phase
FROM phased JOIN fit USING (target_id, feature)"""

# ---- synthesis ----------------------------------------------------------------------------

_CELLS = ["o_orderstatus", "o_orderpriority", "bin"]


def independent() -> str:
    streams = {f"h{i}": STREAM_SYNTH + i for i in range(3)} | {"hb": STREAM_SYNTH + 1000 + 2}
    marginals = " UNION ALL ".join(
        f"SELECT dataset_id, {i} AS col, {c} AS cell, count(*) AS n FROM cells GROUP BY dataset_id, {c}"
        for i, c in enumerate(_CELLS)
    )
    joins = "".join(
        f" JOIN cum m{i} ON m{i}.dataset_id = r.dataset_id AND m{i}.col = {i}"
        f" AND {u(f'r.h{i}')} * m{i}.total >= m{i}.upto - m{i}.n AND {u(f'r.h{i}')} * m{i}.total < m{i}.upto"
        for i in range(3)
    )
    frames = """(SELECT dataset_id, unnest(range(0, (SELECT greatest(count(*) // 10, 1) FROM orders)))
    AS row_no FROM ends)"""
    return f"""WITH {ORDERS}, tabs AS (SELECT *, o_custkey % 5 AS dataset_id FROM ord),
ends AS (SELECT dataset_id, min(band)::DOUBLE AS low, max(band)::DOUBLE AS high FROM tabs GROUP BY dataset_id),
cells AS (SELECT *, least(floor(coalesce((band::DOUBLE - low) / nullif(high - low, 0), 0) * 20), 19)::BIGINT
  AS bin FROM tabs JOIN ends USING (dataset_id)),
marg AS ({marginals}),
cum AS (SELECT *, (sum(n) OVER (PARTITION BY dataset_id, col ORDER BY cell))::DOUBLE AS upto,
  (sum(n) OVER (PARTITION BY dataset_id, col))::DOUBLE AS total FROM marg),
drawn AS (SELECT * FROM {staged(frames, 31, ['dataset_id', 'row_no'], streams)})
SELECT r.dataset_id, r.row_no, m0.cell AS o_orderstatus, m1.cell AS o_orderpriority,
  round(low + (m2.cell + {u('r.hb')}) * (high - low) / 20.0::DOUBLE, 6) AS band
FROM drawn r{joins} JOIN ends ON ends.dataset_id = r.dataset_id"""


ORACLE["synth_independent"] = independent()

# ---- metrics and results ------------------------------------------------------------------


def metrics(source: str, groups: str) -> str:
    """accuracy and rank-sum AUC of (groups, s, y)."""
    return f"""(SELECT {groups}, avg(((s > 0.5)::INT = y)::INT) AS accuracy,
  CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN
    (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) END AS auc
  FROM (SELECT *, rank() OVER (PARTITION BY {groups} ORDER BY s)
    + (count(*) OVER (PARTITION BY {groups}, s) - 1) / 2.0::DOUBLE AS r FROM {source}) GROUP BY {groups})"""


_METRIC = "round(accuracy, 6) AS accuracy, round(auc, 6) AS auc"
ORACLE["binary_metrics"] = f"""WITH sc AS (SELECT lang, quality AS y, n_chars / 4000.0::DOUBLE AS s
  FROM documents JOIN labels USING (doc_id))
SELECT lang, {_METRIC} FROM {metrics('sc', 'lang')}"""
NATIONS = f"""{CUSTOMERS},
sc AS (SELECT c_nationkey AS record_id, 'logistic_regression' AS model, (c_mktsegment < 2)::INT AS y,
  band / 10.0::DOUBLE AS s FROM cust UNION ALL
  SELECT c_nationkey, 'random_forest', (c_mktsegment < 2)::INT,
  ({hash1(5, 'record_id', 3)} % 1000) / 1000.0::DOUBLE FROM cust),
mets AS (SELECT * FROM {metrics('sc', 'record_id, model')})"""
ORACLE["audit_results_table"] = f"""WITH {NATIONS}
SELECT record_id AS record, {_METRIC}, model,
  CASE model WHEN 'random_forest' THEN 'Random Forest' ELSE 'Logistic Regression' END AS model_name FROM mets"""
ORACLE["aggregate_targets"] = f"""WITH {NATIONS}
SELECT model, count(*) AS n_targets, round(avg(accuracy), 6) AS mean_accuracy, round(avg(auc), 6) AS mean_auc
FROM mets GROUP BY model"""
ORACLE["write_results"] = f"WITH {NATIONS} SELECT record_id, model, {_METRIC} FROM mets"
ORACLE["resume_targets"] = f"""WITH {NATIONS} SELECT DISTINCT c_nationkey AS record_id FROM cust
WHERE c_nationkey NOT IN (SELECT record_id FROM mets WHERE model = 'random_forest' AND accuracy >= 0.5)"""

# ---- attribute audit ----------------------------------------------------------------------


def probes() -> str:
    rows = []
    for pos, q in enumerate(PROBES):
        number = 0
        for c in q:
            number = number * 3 + c + 1
        rows.append(f"({pos}, {number}::BIGINT, {', '.join(map(str, q))})")
    return f"pro AS (SELECT * FROM (VALUES {', '.join(rows)}) AS t(pos, query_id, c0, c1, c2, c3))"


_ANSWER_MATCH = matches(_FULL, "a", "vals")
ANSWERS = f"""{auxiliary(8)}, {probes()}, vals AS (SELECT * , 1 AS sensitive FROM target),
cnts AS (SELECT dataset_id, query_id, pos, count(*) FILTER ({_ANSWER_MATCH}) AS cnt,
  coalesce(bit_xor(user_hash) FILTER ({_ANSWER_MATCH}), 0) AS set_hash
  FROM (SELECT *, {mix('record_id + 1')} AS user_hash FROM auxs) a, vals, pro
  GROUP BY dataset_id, query_id, pos)"""
ORACLE["answer_cache"] = (
    f"WITH {ANSWERS} {sticky('cnts', 41, 'dataset_id, query_id, 0::BIGINT AS variant')}"
)
ORACLE["answer_matrix"] = f"""WITH {ANSWERS},
labs AS (SELECT dataset_id, phase, sensitive AS label FROM auxs WHERE record_id = 5)
SELECT dataset_id, phase, string_agg(cnt::VARCHAR, ',' ORDER BY pos) AS features, any_value(label) AS label
FROM cnts JOIN labs USING (dataset_id) GROUP BY dataset_id, phase"""
_COPIES = f"""(SELECT * EXCLUDE (h) REPLACE (CASE WHEN record_id = 5 THEN h & 1 ELSE sensitive END AS sensitive),
  {mix('record_id + 1')} AS user_hash FROM {bits(f'(SELECT * FROM fixed, {numbers(64)})', 6)})"""
ORACLE["overlay_answers"] = f"""WITH {CUSTOMERS}, {FIXED}, {probes()},
vals AS (SELECT *, 1 AS sensitive FROM cust WHERE record_id = 5),
cnts AS (SELECT dataset_id, query_id, count(*) FILTER ({_ANSWER_MATCH}) AS cnt,
  coalesce(bit_xor(user_hash) FILTER ({_ANSWER_MATCH}), 0) AS set_hash
  FROM {_COPIES} a, vals, pro GROUP BY dataset_id, query_id)
{sticky('cnts', 41, 'dataset_id, query_id, 0::BIGINT AS variant')}"""
# A search of 8 solutions and 4 generations, cut after the second, goes on as if it had not been cut.
ORACLE["search_restart"] = """SELECT range AS generation, 8::BIGINT AS n_solutions, 8::BIGINT AS n_same, 0::BIGINT AS n_repeated
FROM range(4)"""
