"""Keys and references of several columns, found in the data (PRF-2, PRF-3).

A database names its keys, whatever they are called and however many columns
they have; files do not.  Two level-wise searches find them:

* ``composite_keys`` - the minimal unique column combinations.  Level k looks
  at combinations of k columns without NULLs that hold no smaller key.  Those
  whose columns' distinct counts multiply to less than the row count fall out
  first (HyperLogLog counts of single columns, ``SIGMAS`` standard errors of slack).
  The next sift takes the rows whose most distinct column has a hash below a limit that
  leaves about ``ROWS`` of them: equal tuples share it, so all copies of a tuple are
  there or none, and most combinations show a repeat (tables of over ``WHOLE_ROWS``
  rows: then of ``RESIFT`` times as many).  Only what is left is tested on all rows:
  by an aggregation of (combination, 128 bits of the tuple), of large tables by
  sorted blocks of 5 bytes a row; where such keys repeat, the 128 bits of those rows decide.
* ``inclusion_dependencies`` - which columns, and which pairs of columns, hold
  only values of others, whatever their names.  Column pairs of one type family
  must pass bounds (minimum, maximum, distinct count) and a coordinated sample:
  every column keeps the hashes below a limit that leaves about ``SAMPLE`` of
  its distinct values; a child's hash below both limits that the parent lacks
  refutes the pair.  Equal values have equal hashes, so no true pair is lost.
  Survivors are tested on all values (``profile.inclusion_test``); pairs of
  columns are built from valid single ones (apriori) and go the same way.

Counts, bounds and samples are schema-sized (a row per column or candidate, at
most about ``SAMPLE`` hashes a column) and are all that reaches the driver.
Columns of nested types are left out.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .profile import _type_family, _typed_value, inclusion_test

RSD = 0.05  # relative standard deviation of the HyperLogLog counts
SIGMAS = 5
SAMPLE = 512
ROWS = 20_000
SKETCHES_AT_ONCE = 32  # HyperLogLog counts of one aggregate
HASHES = 1 << 62
WHOLE_ROWS = 1 << 20  # tables of more rows are tested by sorted blocks of keys
RESIFT = 64  # times ROWS, of their second sample
RANGE_ROWS = 1 << 17  # of a table in a range of keys, about
REPEATS = 8  # repeated keys told of a range
BLOCK_ENTRIES = 1 << 22  # rows times combinations of a block, and of a task that sorts ranges
SCAN_COMBOS = 16  # combinations of one scan


def _plain(df: DataFrame) -> list[str]:
    """Columns that can be compared and hashed as they are."""
    nested = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, nested)]


def _value(df: DataFrame, name: str) -> Column:
    """A column with -0.0 as 0.0, so that equal values have equal hashes."""
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return F.when(c == 0, F.lit(0.0)).otherwise(c)
    return c


def _bound(estimate: int) -> float:
    """More distinct values than a column of this HyperLogLog count can hold."""
    return estimate * (1 + SIGMAS * RSD) + 1


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _parts(items: list, size: int):
    return (items[i: i + size] for i in range(0, len(items), size))


# ---------------------------------------------------------------- PRF-2, several columns

Combination = tuple[str, tuple[str, ...]]


def _distinct_estimates(tables: dict[str, DataFrame], combos: list[Combination]) -> dict[Combination, int]:
    """HyperLogLog counts of all columns: one aggregate row a table, one job."""
    parts, ids = [], {}
    for t, group in itertools.groupby(combos, key=lambda x: x[0]):
        for some in _parts(list(group), SKETCHES_AT_ONCE):
            for combo in some:
                ids[len(ids)] = combo
            first = len(ids) - len(some)
            wide = tables[t].agg(*[F.approx_count_distinct(F.xxhash64(*[_value(tables[t], c) for c in cols]), RSD).alias(f"d{i}")
                                   for i, (_, cols) in enumerate(some)])
            parts.append(wide.select(F.inline(F.array(*[F.struct(F.lit(first + i).alias("id"), F.col(f"d{i}").alias("d")) for i in range(len(some))]))))
    return {ids[r["id"]]: r["d"] for r in _union(parts).collect()} if parts else {}


Sample = dict[Combination, tuple[str, int]]


def _drawn(df: DataFrame, column: str, below: int) -> DataFrame:
    """The rows with a hash of ``column`` below the limit, and with them all rows that could
    repeat them, and an eighth as many at random (they show frequent tuples)."""
    if below >= HASHES:
        return df
    return df.where((F.pmod(F.xxhash64(_value(df, column)), F.lit(HASHES)) < below) | (F.rand(7) < below / HASHES / 8))


def _tuples(tables: dict[str, DataFrame], combos: list[Combination], size: int, sample: Sample | None = None) -> list[DataFrame]:
    """Every row of every combination as ``id`` (its place in ``combos``) and 128 bits of
    the tuple, padded to ``size`` columns by its last one.  ``sample`` gives a combination's
    column and limit: only the rows drawn by it take part."""
    parts = []
    ids = dict(enumerate(combos))
    drawn = lambda i: (sample or {}).get(ids[i], ("", HASHES))
    for (t, column, below), group in itertools.groupby(sorted(ids, key=lambda i: (ids[i][0], drawn(i))), key=lambda i: (ids[i][0], *drawn(i))):
        group, df = list(group), _drawn(tables[t], column, below)
        names = sorted({c for i in group for c in ids[i][1]})
        # Columns are hashed once; a combination is a constant row of their places (the last
        # one repeated), so the code that is generated does not grow with the combinations.
        places = [[names.index(c) for c in ids[i][1]] for i in group]
        each = F.array(*[F.struct(F.lit(i).alias("id"), *[F.lit(p[min(k, len(p) - 1)]).alias(f"p{k}") for k in range(size)]) for i, p in zip(group, places)])
        first = F.array(*[F.xxhash64(_value(df, c)) for c in names])
        second = F.array(*[F.xxhash64(F.lit("second"), _value(df, c)) for c in names])
        rows = df.select(first.alias("f"), second.alias("s")).select("f", "s", F.inline(each))
        parts.append(rows.select("id", *[F.xxhash64(*[F.get(c, F.col(f"p{k}")) for k in range(size)]).alias(h) for c, h in (("f", "h1"), ("s", "h2"))]))
    return parts


def _shared(rows: DataFrame) -> set[int]:
    """The ids of combinations with a tuple of two rows or more: one aggregation with
    map-side combining, so a frequent tuple is a row a task."""
    per = rows.groupBy("id", "h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    return {r["id"] for r in per.groupBy("id").agg(F.max("n").alias("n")).where("n > 1").collect()}


def _unique(tables: dict[str, DataFrame], combos: list[Combination], sample: Sample | None = None) -> list[Combination]:
    """The combinations that no two rows (of the sample) share."""
    if not combos:
        return []
    shared = _shared(_union(_tuples(tables, combos, max(len(cols) for _, cols in combos), sample)))
    return [x for i, x in enumerate(combos) if i not in shared]


def _repeated_keys(df: DataFrame, combos: dict[int, tuple[str, ...]], size: int, n: int, bits: int) -> DataFrame:
    """``id, key, more``: keys (the leading ``bits`` + 40 bits of the first hash of ``_tuples``) that
    two rows or more of a combination have, at most ``REPEATS`` of each range of keys; ``more``: there
    are others.  Tasks send sorted blocks of 5 bytes a row, which a row of the shuffle holds by
    the thousand, and every range is sorted by itself."""
    ids, ranges, entries, repeats = list(combos), 1 << bits, BLOCK_ENTRIES, REPEATS
    places = {c: k for k, c in enumerate(sorted({c for cols in combos.values() for c in cols}))}
    hashed = df.select(F.array(*[F.xxhash64(_value(df, c)) for c in places]).alias("f"))
    wide = hashed.select(*[F.xxhash64(*[F.get("f", F.lit(places[cols[min(k, len(cols) - 1)]])) for k in range(size)]).alias(f"h{i}") for i, cols in combos.items()])

    def pack(batches):
        def block(held):
            for k, i in enumerate(ids):
                key = np.sort(np.concatenate([h[k] for h in held]).view(np.uint64) >> np.uint64(24 - bits))
                key = key[np.append(np.ones(min(2, len(key)), bool), key[2:] != key[:-2])]  # two of a kind tell all
                cuts = 5 * np.searchsorted(key >> np.uint64(40), np.arange(ranges + 1, dtype=np.uint64))
                data = np.ascontiguousarray(key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()
                some = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), i, np.int32)), pa.array(some.astype(np.int32)),
                                                  pa.array([data[cuts[r]: cuts[r + 1]] for r in some], pa.binary())], names=["id", "part", "data"])

        held, n_held = [], 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            n_held += batch.num_rows * len(ids)
            if n_held >= entries:
                yield from block(held)
                held, n_held = [], 0
        if n_held:
            yield from block(held)

    def find(batches):
        held: dict[tuple[int, int], list[bytes]] = {}
        for batch in batches:
            for i, r, data in zip(*[c.to_pylist() for c in batch.columns]):
                held.setdefault((i, r), []).append(data)
        for (i, r), parts in held.items():
            raw = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 5)
            low = np.zeros((len(raw), 8), np.uint8)
            low[:, :5] = raw
            low = np.sort(low.view("<u8").ravel())
            again = np.unique(low[1:][low[1:] == low[:-1]])
            if len(again):
                key = (again[:repeats] | np.uint64(r << 40)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), i, np.int32)), pa.array(key), pa.array([len(again) > repeats] * len(key))], names=["id", "key", "more"])

    tasks = max(1, n * len(ids) // BLOCK_ENTRIES)
    blocks = wide.mapInArrow(pack, "id int, part int, data binary").repartition(tasks, "id", "part")
    return blocks.mapInArrow(find, "id int, key bigint, more boolean")


def _unique_whole(tables: dict[str, DataFrame], combos: list[Combination], rows: dict[str, int], sample: Sample | None = None) -> list[Combination]:
    """As ``_unique``, for large tables with a fifth of the shuffle: rows without a repeated
    key are unique; the few rows of a repeated one are compared by 128 bits."""
    if not combos:
        return []
    size = max(len(cols) for _, cols in combos)
    out = set(_unique(tables, [x for x in combos if rows[x[0]] <= WHOLE_ROWS], sample))
    drawn = lambda x: (x[0], *(sample or {}).get(x, ("", HASHES)))
    for (t, column, below), group in itertools.groupby(sorted((x for x in combos if rows[x[0]] > WHOLE_ROWS), key=drawn), key=drawn):
        mine, n = list(group), max(1, rows[t] * below // HASHES)
        bits = min(24, max(1, math.ceil(math.log2(max(2, n / RANGE_ROWS)))))
        df = _drawn(tables[t], column, below)
        again = [r for some in _parts(list(enumerate(mine)), SCAN_COMBOS)
                 for r in _repeated_keys(df, {i: cols for i, (_, cols) in some}, size, n, bits).collect()]
        suspect = sorted({r["id"] for r in again})
        out.update(x for i, x in enumerate(mine) if i not in suspect)
        if suspect:
            tuples = _union(_tuples(tables, [mine[i] for i in suspect], size, sample)).withColumn("key", F.shiftrightunsigned("h1", 24 - bits))
            keys = df.sparkSession.createDataFrame([(suspect.index(r["id"]), r["key"]) for r in again], "id int, key bigint")
            shared = _shared(tuples.join(F.broadcast(keys), ["id", "key"]))
            others = {r["id"] for r in again if r["more"]}
            left = [i for k, i in enumerate(suspect) if k not in shared]
            out.update(mine[i] for i in left if i not in others)
            out.update(_unique(tables, [mine[i] for i in left if i in others], sample))  # keys met by chance, too many to list
    return [x for x in combos if x in out]


@dataclass
class KeySearch:
    keys: list[tuple[str, tuple[str, ...], int]]  # table, columns, rows
    looked_at: int  # combinations of columns without NULLs
    bounded: int  # left by the product bound
    tested: int  # left by the sample of hashes, and tested on all rows


def find_keys(tables: dict[str, DataFrame], max_size: int = 3) -> KeySearch:
    counts = {}
    singles = []
    for t, df in tables.items():
        names = _plain(df)
        nulls = [F.struct(F.lit(c).alias("c"), F.count_if(F.col(f"`{c}`").isNull()).alias("z")) for c in names]
        counts[t] = df.agg(F.count(F.lit(1)).alias("n"), F.array(*nulls).alias("nulls")).select(F.lit(t).alias("t"), "n", "nulls")
    rows = {r["t"]: r for r in _union(list(counts.values())).collect()} if counts else {}
    for t in tables:
        if rows[t]["n"]:
            singles += [(t, (x["c"],)) for x in rows[t]["nulls"] if not x["z"]]
    below = {t: HASHES * ROWS // max(ROWS, r["n"]) for t, r in rows.items()}
    distinct = {x: _bound(d) for x, d in _distinct_estimates(tables, singles).items()}
    found: list[Combination] = []
    looked = bounded = tested = 0
    for size in range(1, max_size + 1):
        combos = []
        for t in tables:
            names = [c[0] for x, c in singles if x == t]
            smaller = [set(cols) for x, cols in found if x == t]
            combos += [(t, cols) for cols in itertools.combinations(names, size) if not any(k <= set(cols) for k in smaller)]
        looked += len(combos)
        combos = [(t, cols) for t, cols in combos if math.prod(distinct[t, (c,)] for c in cols) >= rows[t]["n"]]
        bounded += len(combos)
        sample = {(t, cols): (max(cols, key=lambda c: distinct[t, (c,)]), below[t]) for t, cols in combos}  # noqa: B023
        left = _unique(tables, combos, sample)
        whole = [x for x in left if below[x[0]] == HASHES]  # every row was in the sample
        rest = [x for x in left if below[x[0]] < HASHES]
        # A table of many rows is sifted once more: testing one combination on all rows costs more.
        n_rows = {t: r["n"] for t, r in rows.items()}
        again = [x for x in rest if n_rows[x[0]] > WHOLE_ROWS and RESIFT * sample[x][1] < HASHES]
        refuted = set(again) - set(_unique_whole(tables, again, n_rows, {x: (sample[x][0], RESIFT * sample[x][1]) for x in again}))
        rest = [x for x in rest if x not in refuted]
        tested += len(rest)
        whole += _unique_whole(tables, rest, n_rows)
        found += sorted(whole, key=combos.index)
    return KeySearch([(t, cols, rows[t]["n"]) for t, cols in found], looked, bounded, tested)


def composite_keys(spark: SparkSession, tables: dict[str, DataFrame], max_size: int = 3) -> DataFrame:
    """PRF-2: the minimal combinations of up to ``max_size`` columns that are without NULL and
    unique: ``table_name, key_columns`` (in schema order, comma-joined), ``key_size, n_rows``.
    A table without rows has no key."""
    keys = find_keys(tables, max_size).keys
    return spark.createDataFrame([(t, ",".join(cols), len(cols), n) for t, cols, n in keys],
                                 "table_name string, key_columns string, key_size int, n_rows bigint")


# ---------------------------------------------------------------- PRF-3, any name, several columns

Pair = tuple[Combination, Combination]  # child, parent


def _tuple_text(df: DataFrame, cols: tuple[str, ...]) -> Column:
    """A pair of values as one text that no other pair has; NULL if one is NULL."""
    texts = [_typed_value(_value(df, c), df.schema[c].dataType)[1].cast("string") for c in cols]
    return F.concat(F.length(texts[0]).cast("string"), F.lit(":"), *texts)


def _hashed(df: DataFrame, cols: tuple[str, ...]) -> Column:
    """62 bits of a column's or pair's value; NULL if it is NULL."""
    value = _typed_value(_value(df, cols[0]), df.schema[cols[0]].dataType)[1] if len(cols) == 1 else _tuple_text(df, cols)
    return F.when(value.isNotNull(), F.pmod(F.xxhash64(value), F.lit(HASHES)))


def _bounds(tables: dict[str, DataFrame], columns: list[Combination]) -> dict[Combination, tuple]:
    """(distinct estimate, minimum, maximum) of single columns and pairs, one aggregate row a table.
    Minimum and maximum are of single columns in their own order, as (long, double, text)."""
    parts, ids = [], {}
    for t, group in itertools.groupby(columns, key=lambda x: x[0]):
        for some in _parts(list(group), SKETCHES_AT_ONCE):
            df, aggs, out = tables[t], [], []
            for combo in some:
                i = len(ids)
                ids[i] = combo
                cols = combo[1]
                aggs.append(F.approx_count_distinct(_hashed(df, cols), RSD).alias(f"d{i}"))
                family, v = _typed_value(_value(df, cols[0]), df.schema[cols[0]].dataType)
                single = len(cols) == 1
                if single:
                    aggs += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
                ends = [F.col(f"{e}{i}").alias(f"{e}_{k}") if single and k == family else F.lit(None).cast(kind).alias(f"{e}_{k}")
                        for e in ("lo", "hi") for k, kind in (("long", "bigint"), ("double", "double"), ("text", "string"))]
                out.append(F.struct(F.lit(i).alias("id"), F.col(f"d{i}").alias("d"), *ends))
            parts.append(df.agg(*aggs).select(F.inline(F.array(*out))))
    got = {}
    for r in _union(parts).collect() if parts else []:
        lo, hi = (next((r[f"{e}_{k}"] for k in ("long", "double", "text") if r[f"{e}_{k}"] is not None), None) for e in ("lo", "hi"))
        got[ids[r["id"]]] = r["d"], lo, hi
    return got


def _possible(child: tuple, parent: tuple) -> bool:
    """Whether bounds allow that the parent holds all the child's values."""
    d, lo, hi = child
    pd, plo, phi = parent
    if not d or d / (1 + SIGMAS * RSD) - 1 > _bound(pd):
        return False
    if isinstance(lo, str):  # Spark's and Python's order of texts differ outside ASCII
        if not all(isinstance(x, str) and x.isascii() for x in (lo, hi, plo, phi)):
            return True
    return lo is None or plo is not None and (lo != lo or hi != hi or plo <= lo and (phi != phi or hi <= phi))


def _not_refuted(tables: dict[str, DataFrame], pairs: list[Pair], estimates: dict[Combination, tuple]) -> list[Pair]:
    """The pairs that the coordinated sample leaves: one scan a table, hashes below each limit."""
    columns = sorted({x for pair in pairs for x in pair})
    limit = {x: min(HASHES, HASHES * SAMPLE // max(1, estimates[x][0])) for x in columns}
    parts = []
    ids = dict(enumerate(columns))
    for t, group in itertools.groupby(ids, key=lambda i: ids[i][0]):
        rows = [F.struct(F.lit(i).alias("id"), _hashed(tables[t], ids[i][1]).alias("h"), F.lit(limit[ids[i]]).alias("below")) for i in group]
        parts.append(tables[t].select(F.inline(F.array(*rows))).where("h < below").select("id", "h"))
    if not parts:
        return []
    held: dict[int, set[int]] = {i: set() for i in ids}
    for r in _union(parts).distinct().collect():  # about SAMPLE hashes a column
        held[r["id"]].add(r["h"])
    at = {x: i for i, x in ids.items()}

    def stands(child: Combination, parent: Combination) -> bool:
        both = min(limit[child], limit[parent])
        return all(h in held[at[parent]] for h in held[at[child]] if h < both)

    return [p for p in pairs if stands(*p)]


def _exact(tables: dict[str, DataFrame], pairs: list[Pair]) -> list[tuple[Pair, int]]:
    """The pairs that hold on all values, with the child's distinct values."""
    if not pairs:
        return []
    names: dict[Combination, str] = {}
    for pair in pairs:
        for x in pair:
            names.setdefault(x, f"c{len(names)}")
    frames = {t: tables[t].select(*[(F.col(f"`{cols[0]}`") if len(cols) == 1 else _tuple_text(tables[t], cols)).alias(names[x, cols])
                                    for x, cols in names if x == t]) for t in {x[0] for x in names}}
    told = {(names[c], names[p]): (c, p) for c, p in pairs}
    rows = inclusion_test(frames, [(c[0], names[c], p[0], names[p]) for c, p in pairs]).where("is_fk").collect()
    return [(told[r["child_column"], r["parent_column"]], r["child_distinct"]) for r in rows]


@dataclass
class InclusionSearch:
    found: list[tuple[Pair, int]]
    candidates: dict[int, int]  # by number of columns: pairs of one type
    bounded: dict[int, int]  # left by the bounds
    sampled: dict[int, int]  # left by the sample, and tested on all values


def find_inclusions(tables: dict[str, DataFrame], max_columns: int = 2) -> InclusionSearch:
    def family(x: Combination) -> tuple[str, str]:
        kind = tables[x[0]].schema[x[1][0]].dataType
        return _type_family(kind), _typed_value(F.lit(None), kind)[0]

    columns = [(t, (c,)) for t, df in tables.items() for c in _plain(df)]
    out = InclusionSearch([], {}, {}, {})
    pairs = [(c, p) for c in columns for p in columns if c != p and family(c) == family(p)]
    estimates: dict[Combination, tuple] = {}
    for size in (1, 2)[:max_columns]:
        out.candidates[size] = len(pairs)
        new = sorted({x for pair in pairs for x in pair} - estimates.keys(), key=lambda x: (list(tables).index(x[0]), x[1]))
        estimates |= _bounds(tables, new)
        pairs = [p for p in pairs if _possible(estimates[p[0]], estimates[p[1]])]
        out.bounded[size] = len(pairs)
        pairs = _not_refuted(tables, pairs, estimates)
        out.sampled[size] = len(pairs)
        valid = _exact(tables, pairs)
        out.found += valid
        place = {x: i for i, x in enumerate(columns)}
        singles = sorted((p for p, _ in valid), key=lambda p: (place.get(p[0], 0), place.get(p[1], 0)))
        pairs = [((a[0], (a[1][0], b[1][0])), (p[0], (p[1][0], q[1][0]))) for (a, p), (b, q) in itertools.combinations(singles, 2)
                 if a[0] == b[0] != p[0] == q[0] and a != b and p != q]
    return out


def inclusion_dependencies(spark: SparkSession, tables: dict[str, DataFrame], max_columns: int = 2) -> DataFrame:
    """PRF-3 whatever the names: every column, and every pair of columns of one table, whose
    values all stand in the parent's: ``child_table, child_columns, parent_table,
    parent_columns, n_columns, child_distinct, parent_unique``.

    A child needs a value; tuples with a NULL are left out.  A pair of columns (of
    another table than the parent's) counts if each of its columns is included by
    itself.  ``parent_unique``: no two rows of the parent share it, so the child may
    be a foreign key to it."""
    search = find_inclusions(tables, max_columns)
    parents = sorted({p for (_, p), _ in search.found})
    unique = set(_unique_whole(tables, parents, {t: tables[t].count() for t in {x[0] for x in parents}}))
    rows = [(c[0], ",".join(c[1]), p[0], ",".join(p[1]), len(c[1]), n, p in unique) for (c, p), n in search.found]
    return spark.createDataFrame(sorted(rows), "child_table string, child_columns string, parent_table string, parent_columns string, "
                                               "n_columns int, child_distinct bigint, parent_unique boolean")
