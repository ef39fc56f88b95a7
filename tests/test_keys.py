"""Keys and references of several columns against brute force over all combinations."""

import itertools
import random

import pytest

from concord.operators import keys


def brute_keys(rows, names, size=3):
    found = []
    for k in range(1, size + 1):
        for cols in itertools.combinations(range(len(names)), k):
            values = [tuple(r[c] for c in cols) for r in rows]
            if rows and all(None not in v for v in values) and len(set(values)) == len(rows) and not any(set(f) <= set(cols) for f in found):
                found.append(cols)
    return {",".join(names[c] for c in f) for f in found}


def _random(seed, n, widths, null=0.0):
    r = random.Random(seed)
    return [tuple(None if r.random() < null else r.randrange(w) for w in widths) for _ in range(n)]


@pytest.mark.parametrize("sample", [10, 20_000])
def test_minimal_keys_equal_all_combinations(spark, monkeypatch, sample):
    monkeypatch.setattr(keys, "ROWS", sample)
    tables, want = {}, {}
    for seed, (n, widths) in enumerate([(30, (3, 4, 5, 6)), (200, (20, 30, 40, 2)), (12, (12, 2, 9)), (1, (3, 3)), (60, (1000, 8, 9, 10, 2))]):
        rows = _random(seed, n, widths) if seed != 2 else [(i, i % 2, None if i == 3 else i) for i in range(n)]
        names = [f"c{i}" for i in range(len(widths))]
        tables[f"t{seed}"] = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in names))
        want[f"t{seed}"] = brute_keys(rows, names)
    tables["empty"] = tables["t0"].limit(0)
    got = keys.composite_keys(spark, tables).collect()
    assert {t: {r["key_columns"] for r in got if r["table_name"] == t} for t in want} == want
    assert not [r for r in got if r["table_name"] == "empty"]


def test_large_tables_are_tested_by_blocks_of_keys(spark, monkeypatch):
    for name, value in (("ROWS", 10), ("RESIFT", 2), ("WHOLE_ROWS", 20), ("RANGE_ROWS", 8), ("REPEATS", 1), ("BLOCK_ENTRIES", 64), ("SCAN_COMBOS", 2)):
        monkeypatch.setattr(keys, name, value)
    pairs = [r for r in itertools.product(range(30), range(20), range(2))]
    rows = [(a, b, c, 40 * a + 2 * b + c) for a, b, c in pairs] + [(30, b, 2, 1200 + b) for b in range(5)] + [(30, 6, 2, 1204)]
    tables = {"t": spark.createDataFrame(rows, "a int, b int, c int, d int"), "u": spark.createDataFrame(rows[:-1], "a int, b int, c int, d int")}
    got = keys.composite_keys(spark, tables).collect()
    want = {(t, k) for t, r in (("t", rows), ("u", rows[:-1])) for k in brute_keys(r, "abcd")}
    assert {(r["table_name"], r["key_columns"]) for r in got} == want and ("t", "a,b,c") in want
    # One range and all combinations at once shuffle a row of blocks, not a row of each tuple.
    blocks = keys._repeated_keys(spark.range(1000).selectExpr("id % 999 AS a", "id AS b"), {0: ("a",), 1: ("b",)}, 1, 1000, 1).collect()
    assert [(r["id"], r["more"]) for r in blocks] == [(0, False)]
    # Keys that meet by chance are no repeats.
    fake = spark.createDataFrame([(0, 5, True), (1, 5, False)], "id int, key bigint, more boolean")
    monkeypatch.setattr(keys, "_repeated_keys", lambda *a: fake)
    assert keys._unique_whole({"u": tables["u"]}, [("u", ("d",)), ("u", ("a", "b", "c"))], {"u": len(rows) - 1}) == [("u", ("d",)), ("u", ("a", "b", "c"))]


def test_key_values_of_other_types_and_samples_prune(spark, monkeypatch):
    df = spark.createDataFrame([(float(i % 10), f"n{i // 10}", i % 2 == 0, [i]) for i in range(100)], "d double, s string, b boolean, a array<int>")
    zeros = spark.createDataFrame([(0.0, 1), (-0.0, 1)], "d double, k int")
    got = {(r["table_name"], r["key_columns"]) for r in keys.composite_keys(spark, {"t": df, "z": zeros}).collect()}
    assert got == {("t", "d,s")}
    wide = spark.range(5000).selectExpr("id % 7 AS a", "id % 11 AS b", "id % 5000 AS c", "id % 13 AS d", "id % 17 AS e", "id % 3 AS f")
    monkeypatch.setattr(keys, "ROWS", 100)
    search = keys.find_keys({"w": wide})
    assert [k[1] for k in search.keys] == [("c",)] and search.tested <= 3 and search.bounded < search.looked_at


def brute_inclusions(tables):
    cols = [(t, c) for t, (names, _) in tables.items() for c in range(len(names))]
    value = lambda t, cs: {v for r in tables[t][1] if None not in (v := tuple(r[c] for c in cs))}
    name = lambda t, cs: ",".join(tables[t][0][c] for c in cs)
    single = {(a, b) for a in cols for b in cols if a != b and (x := value(a[0], a[1:])) and x <= value(b[0], b[1:])}
    out = {(a[0], name(a[0], a[1:]), b[0], name(b[0], b[1:])) for a, b in single}
    for ct, pt in itertools.permutations(tables, 2):
        for a, b in itertools.combinations(range(len(tables[ct][0])), 2):
            for p, q in itertools.permutations(range(len(tables[pt][0])), 2):
                if {((ct, a), (pt, p)), ((ct, b), (pt, q))} <= single and (x := value(ct, (a, b))) and x <= value(pt, (p, q)):
                    out.add((ct, name(ct, (a, b)), pt, name(pt, (p, q))))
    return out


def test_inclusions_equal_all_pairs(spark, monkeypatch):
    parent = [(i, i % 7, 100 + i % 5) for i in range(200)]
    r = random.Random(2)
    child = [(*r.choice(parent)[:2], r.choice([None, 3, 104])) for _ in range(80)] + [(None, 3, 100), (5, None, None)]
    odd = [(i, r.randrange(8)) for i in range(0, 400, 2)]
    data = {"parent": (["k", "line", "kind"], parent), "child": (["ref_a", "ref_b", "x"], child), "odd": (["n", "m"], odd), "none": (["v"], [(None,)] * 3)}
    tables = {t: spark.createDataFrame(rows, ", ".join(f"{c} bigint" for c in names)) for t, (names, rows) in data.items()}
    want = brute_inclusions(data)
    assert ("child", "ref_a,ref_b", "parent", "k,line") in want
    for sample in (4, 512):
        monkeypatch.setattr(keys, "SAMPLE", sample)
        got = keys.inclusion_dependencies(spark, tables).collect()
        assert {tuple(r)[:4] for r in got} == want
    assert {r["parent_columns"]: r["parent_unique"] for r in got if r["parent_table"] == "parent"}["k,line"] is True


def test_sample_and_bounds_refute_most_pairs(spark):
    tables = {f"t{i}": spark.range(3000).selectExpr(f"id * {i + 2} AS a", f"id + {i * 10} AS b") for i in range(4)}
    search = keys.find_inclusions(tables)
    assert search.candidates[1] == 56 and search.bounded[1] < 40 and search.sampled[1] == len([1 for (c, _), _ in search.found if len(c[1]) == 1])
    texts = {"p": spark.createDataFrame([("é",), ("a",), ("z",)], "s string"), "c": spark.createDataFrame([("é",)], "t string")}
    assert [tuple(r)[:4] for r in keys.inclusion_dependencies(spark, texts).collect()] == [("c", "t", "p", "s")]
