"""End to end: one part, granule-sized parts, many parts, and what inserts reject."""

import math
from decimal import Decimal

import pytest

from lamina import Engine, TableSchema
from lamina.plans.dialect import DialectError
from lamina.sources import parts as parts_module
from lamina.sources.parts import MANIFEST, Part, visible

WIDE = TableSchema.of(
    "wide",
    {"ts": "I64", "i8_c": "I8", "i16_c": "I16", "i32_c": "I32", "u8_c": "U8", "u16_c": "U16", "u32_c": "U32", "u64_c": "U64", "f32_c": "F32", "f64_c": "F64", "flag": "Bool", "label": "Str"},
    (0,),
)
SIZES = [700, 1024, 1536, 513, 999, 2048, 1025, 1537, 1300, 2049, 800, 1600, 900, 2000, 1111, 512, 1024, 777, 1234, 2047]


def counted(spark, low, high):
    i, small = "id", "id % 100"
    return spark.range(low, high).selectExpr(
        i, small, i, i, small, i, i, i, f"float({i})", f"double({i})", f"{i} % 2 = 0", f"if({i} % 2 = 0, 'a', 'b')"
    )


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    engine = Engine(spark, str(tmp_path_factory.mktemp("small")), strict=True)
    engine.create_table(WIDE)
    engine.insert("wide", [(i, i, i, i, i, i, i, i, 10.0 * i, 10.0 * i, i % 2 == 1, "a" if i % 2 else "b") for i in range(1, 7)])
    return engine


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    engine = Engine(spark, str(tmp_path_factory.mktemp("many")), strict=True)
    engine.create_table(WIDE)
    at = 0
    for n in SIZES:
        engine.insert("wide", counted(spark, at, at + n).coalesce(1))
        at += n
    return engine


def rows(engine, sql):
    return sorted(tuple(r) for r in engine.sql(sql).collect())


@pytest.mark.parametrize("c,want", [(c, 21) for c in ("ts", "i8_c", "i16_c", "i32_c", "u8_c", "u16_c", "u32_c", "u64_c")] + [("f32_c", 210.0), ("f64_c", 210.0)])
def test_sum(small, c, want):
    assert rows(small, f"SELECT SUM({c}) FROM wide") == [(want,)]


def test_result_types_and_names(small):
    df = small.sql("SELECT SUM(ts), SUM(u8_c), SUM(f32_c), COUNT(label), MIN(i16_c), MAX(u32_c), AVG(ts) FROM wide")
    assert df.columns == ["sum(ts)", "sum(u8_c)", "sum(f32_c)", "count(label)", "min(i16_c)", "max(u32_c)", "avg(ts)"]
    assert [t for _, t in df.dtypes] == ["bigint", "decimal(20,0)", "double", "bigint", "smallint", "bigint", "double"]
    assert tuple(df.first()) == (21, 21, 210.0, 6, 1, 6, 3.5)


@pytest.mark.parametrize("where,want", [
    ("ts > 3", [4, 5, 6]), ("ts = 3", [3]), ("ts != 3", [1, 2, 4, 5, 6]), ("ts <> 3", [1, 2, 4, 5, 6]), ("ts >= 4 AND ts <= 5", [4, 5]), ("ts = 1 OR ts = 6", [1, 6]),
    ("ts > 100", []), ("3 < ts", [4, 5, 6]), ("label = 'a'", [1, 3, 5]), ("flag = true", [1, 3, 5]), ("f32_c = 10.0", [1]), ("u64_c >= 6", [6]),
    ("ts = 1 OR ts = 2 AND label = 'a'", [1]), ("ts = i64_like", None), ("1 = 2", []), ("ts < 3 AND 1 = 1", [1, 2]), ("i32_c = i32_c", [1, 2, 3, 4, 5, 6]),
])
def test_where(small, where, want):
    if want is None:
        with pytest.raises(DialectError):
            small.sql(f"SELECT ts FROM wide WHERE {where}")
    else:
        assert rows(small, f"SELECT ts FROM wide WHERE {where}") == [(x,) for x in want]


def test_groups_projections_limits(small):
    assert rows(small, "SELECT label, SUM(f64_c) FROM wide GROUP BY label") == [("a", 90.0), ("b", 120.0)]
    assert rows(small, "SELECT COUNT(ts), label FROM wide GROUP BY label") == [(3, "a"), (3, "b")]
    assert rows(small, "SELECT COUNT(ts) AS n FROM wide GROUP BY label") == [(3,), (3,)]
    assert rows(small, "SELECT label FROM wide GROUP BY label") == [("a",), ("b",)]
    assert small.sql("SELECT * FROM wide").columns == [c.name for c in WIDE.columns]
    assert small.sql("SELECT label, wide.ts AS t, ts FROM wide").columns == ["label", "t", "ts"]
    assert small.sql("SELECT ts FROM wide LIMIT 3").count() == 3
    assert small.collect("SELECT ts FROM wide WHERE ts = 2").to_pydict() == {"ts": [2]}


def test_many_parts(many):
    n = sum(SIZES)
    total = n * (n - 1) // 2
    assert rows(many, "SELECT SUM(ts), SUM(u64_c), SUM(f64_c), COUNT(ts), MIN(i16_c), MAX(u32_c), AVG(ts) FROM wide") == [(total, total, float(total), n, 0, n - 1, (n - 1) / 2)]
    for where, want in [("ts < 100", 100), ("ts >= 0", n), ("ts < 0", 0), ("ts = 5", 1), ("ts < 5000", 5000), ("ts > 3 AND ts < 8", 4), ("ts = 0 OR ts = 1", 2)]:
        assert rows(many, f"SELECT COUNT(ts) FROM wide WHERE {where}") == [(want,)]
    assert rows(many, "SELECT label, COUNT(ts) FROM wide GROUP BY label") == [("a", -(-n // 2)), ("b", n // 2)]
    assert many.sql("SELECT ts, label FROM wide LIMIT 1000").count() == 1000
    assert rows(many, "SELECT COUNT(ts) FROM wide GROUP BY label LIMIT 2") == sorted([(-(-n // 2),), (n // 2,)])


@pytest.mark.parametrize("n", [511, 512, 513])
def test_granule_edges(spark, tmp_path, n):
    engine = Engine(spark, str(tmp_path), strict=True)
    engine.create_table(WIDE)
    engine.insert("wide", counted(spark, 0, n))
    assert rows(engine, "SELECT SUM(i32_c), COUNT(ts), MAX(u16_c) FROM wide") == [(n * (n - 1) // 2, n, n - 1)]
    assert rows(engine, "SELECT COUNT(ts) FROM wide WHERE ts < 512") == [(min(n, 512),)]


def test_parts_are_skipped(many):
    table = many.table("wide")
    for where, parts in [("ts < 700", 1), ("700 > ts", 1), ("u8_c > 99", 0), ("i32_c = 24735", 1), ("f32_c >= 24000.0", 1), ("ts < 700 OR ts >= 24000", 2), ("ts < 0", 0), ("ts < 10 AND label = 'a'", 1)]:
        df = many.sql(f"SELECT ts FROM wide WHERE {where}")
        assert len({f.rsplit("/", 2)[1] for f in df.inputFiles()}) == parts, where
    assert len(table.parts()) == len(SIZES) and table.parts()[0].id == len(SIZES)


def test_spoiled_manifest_skips_nothing(spark, tmp_path):
    engine = Engine(spark, str(tmp_path), strict=True)
    table = engine.create_table(TableSchema.of("t", {"a": "I64"}))
    table.insert_rows([(1,), (2,)])
    table.files.write(f"t/part_00001/{MANIFEST}", "{")
    again = Engine(spark, str(tmp_path), strict=True)
    assert again.sql("SELECT a FROM t WHERE a > 1").count() == 1
    assert again.table("t").parts()[0].ranges == {}


def test_empty_tables_and_inserts(spark, tmp_path):
    engine = Engine(spark, str(tmp_path), strict=True)
    engine.create_table(WIDE)
    assert engine.insert("wide", []) is None and engine.table("wide").parts() == []
    assert tuple(engine.sql("SELECT SUM(ts), MIN(f64_c), COUNT(ts), AVG(ts) FROM wide").first()) == (None, None, 0, None)
    assert rows(engine, "SELECT label, SUM(ts) FROM wide GROUP BY label") == []
    zero = Engine(spark, str(tmp_path), strict=True, empty_as_default=True)
    got = tuple(zero.sql("SELECT SUM(u64_c), MIN(f64_c), COUNT(ts), AVG(ts) FROM wide").first())
    assert got[:3] == (0, 0.0, 0) and math.isnan(got[3])
    assert rows(zero, "SELECT label, SUM(ts) FROM wide GROUP BY label") == []


def test_floats(spark, tmp_path):
    engine = Engine(spark, str(tmp_path), strict=True)
    engine.create_table(TableSchema.of("t", {"x": "F64", "y": "F32"}))
    engine.insert("t", [(1.0, 0.1), (float("nan"), 0.1)])
    engine.insert("t", [(float("-inf"), 0.5), (-0.0, 0.5), (0.0, 0.5)])
    engine.insert("t", [(float("nan"), 2.0)])
    assert engine.sql("SELECT x FROM t WHERE x > 5").count() == 2
    assert engine.sql("SELECT x FROM t WHERE x <= 5").count() == 4
    assert engine.sql("SELECT x FROM t WHERE x != 1.0").count() == 5
    assert engine.sql("SELECT x FROM t WHERE x = 0.0").count() == 2
    assert engine.sql("SELECT x FROM t WHERE y = 0.1").count() == 2
    assert engine.sql("SELECT x FROM t GROUP BY x").count() == 4


def test_unsigned(spark, tmp_path):
    engine = Engine(spark, str(tmp_path), strict=True)
    engine.create_table(TableSchema.of("t", {"u": "U64"}))
    engine.execute(f"INSERT INTO t VALUES ({2**63}), ({2**64 - 1}), (0)")
    assert rows(engine, "SELECT u FROM t WHERE u >= 9223372036854775808") == [(Decimal(2**63),), (Decimal(2**64 - 1),)]
    with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE|overflow|OVERFLOW"):
        engine.sql("SELECT SUM(u) FROM t").collect()


@pytest.mark.parametrize("row", [(None, 1, "a"), (2**31, 1, "a"), (1, -1, "a"), (1, 256, "a"), (1, 1, None)])
def test_bad_rows_reject_the_insert(spark, tmp_path, row):
    engine = Engine(spark, str(tmp_path))
    table = engine.create_table(TableSchema.of("t", {"i": "I32", "u": "U8", "s": "Str"}))
    with pytest.raises(ValueError, match="null or a value out of"):
        engine.insert("t", [(1, 1, "ok"), row])
    assert table.parts() == [] and table.files.names("t") == ["schema.json"]


def test_compaction(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    table = engine.create_table(TableSchema.of("t", {"k": "I64", "v": "Str"}, (0,)))
    assert engine.compact("t") == []
    for k in (3, 1, 2):
        engine.insert("t", [(k, "x"), (k + 10, "y")])
    before = rows(engine, "SELECT k, v FROM t")
    engine.compact("t")
    assert [p.id for p in table.parts()] == [4] and rows(engine, "SELECT k, v FROM t") == before
    assert table.vacuum() == [] and table.vacuum(retention=0)[:3] == ["part_00001", "part_00002", "part_00003"]
    assert [n for n in table.files.names("t") if "_0" in n] == ["merged_00004"]
    assert rows(Engine(spark, str(tmp_path)), "SELECT k, v FROM t") == before


def test_compacted_rows_stay_replaced(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    table = engine.create_table(TableSchema.of("t", {"k": "I64"}, (0,)))
    for k in (1, 2):
        engine.insert("t", [(k,)])
    reader = engine.sql("SELECT k FROM t")
    engine.compact("t")
    engine.insert("t", [(3,)])
    engine.compact("t")
    assert table.parts()[0].replaces == {1, 2, 3, 4} and rows(engine, "SELECT k FROM t") == [(1,), (2,), (3,)]
    assert sorted(r.k for r in reader.collect()) == [1, 2], "a reader in flight"
    table.files.delete("t/part_00001")
    assert rows(Engine(spark, str(tmp_path)), "SELECT k FROM t") == [(1,), (2,), (3,)]
    engine.insert("t", [(4,)])
    assert [(sorted(p.replaces), p.lost) for p in engine.compact("t")] == [([2, 3, 4, 5, 6], True)]
    assert rows(Engine(spark, str(tmp_path)), "SELECT k FROM t") == [(1,), (2,), (3,), (4,)]


def test_many_parts_are_sorted_out_fast():
    import time

    batch = lambda *n: {"s": [list(n)]}
    parts = [Part(i, batches=batch(i, i)) for i in range(1, 60_001)]
    parts += [Part(60_001 + k, replaces=frozenset(range(k * 100 + 1, k * 100 + 101)), batches=batch(k * 100 + 1, k * 100 + 100), merged=True) for k in range(300)]
    parts += [Part(70_000, batches=batch(50_000, 50_000)), Part(70_001, batches=batch(77, 77)), Part(70_002, batches=batch(70_002, 70_002))]
    began = time.process_time()
    got = visible(parts)
    assert time.process_time() - began < 5
    assert [p.id for p in got] == [*range(30_001, 60_001), *range(60_001, 60_301), 70_002]


def test_compaction_takes_small_parts_first(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    table = engine.create_table(TableSchema.of("t", {"k": "I64"}, (0,)))
    engine.insert("t", spark.range(100_000).coalesce(1))
    for k in range(5):
        engine.insert("t", [(k,)])
    big = next(p for p in table.parts() if p.id == 1)
    small = max(p.bytes for p in table.parts() if p.id > 1)
    made = engine.compact("t", target=2 * small + 10)
    assert [sorted(p.replaces) for p in made] == [[2, 3], [4, 5]] and [p.id for p in table.parts()] == [8, 7, 6, 1]
    assert engine.compact("t", at_least=5, target=big.bytes) == []
    assert sorted(engine.compact("t", target=2 * big.bytes)[0].replaces) == [2, 3, 4, 5, 6, 7, 8]
    assert engine.sql("SELECT COUNT(*) FROM t").first()[0] == 100_005


@pytest.mark.parametrize("key", ["k", "same"])
def test_compaction_sorts_ranges_that_fit_in_memory(spark, tmp_path, monkeypatch, key):
    """Parquet packs these rows to a few bytes each, and `same` holds one value: neither may make a task's sort larger."""
    monkeypatch.setattr(parts_module, "SORT_BYTES", 1 << 20, raising=False)
    engine = Engine(spark, str(tmp_path))
    table = engine.create_table(TableSchema.of("t", {"k": "I64", "same": "U64", "v": "Str"}, (("k", "same").index(key),)))
    half = spark.range(20_000).selectExpr("id", "7", "repeat('x', 100)")
    engine.insert("t", half)
    engine.insert("t", half.selectExpr("id + 20000", "7", "'y'"))
    [new] = engine.compact("t")
    files = [spark.read.parquet(f"{table.files.where('t')}/{new.folder}/{n}") for n in table.files.names(f"t/{new.folder}") if n.endswith(".parquet")]
    assert len(files) >= 6
    assert max(table._sorted_bytes(f) for f in files) < 2 << 20
    for f in files:
        held = [r[key] for r in f.collect()]
        assert held == sorted(held)
    want = [tuple(r) for r in half.selectExpr("id", "7", "repeat('x', 100)").union(half.selectExpr("id + 20000", "7", "'y'")).collect()]
    assert rows(engine, "SELECT k, same, v FROM t") == sorted(want)


def test_compacting_again_sorts_ranges_that_fit_in_memory(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(parts_module, "SORT_BYTES", 1 << 20, raising=False)
    engine = Engine(spark, str(tmp_path))
    table = engine.create_table(TableSchema.of("t", {"k": "I64", "v": "Str"}, (0,)))
    for low in (0, 15_000):
        engine.insert("t", spark.range(low, low + 15_000).selectExpr("id", "'x'"))
    engine.compact("t")
    engine.insert("t", spark.range(0, 30_000, 7).selectExpr("id", "'x'"))
    [new] = engine.compact("t")
    files = [n for n in table.files.names(f"t/{new.folder}") if n.endswith(".parquet")]
    assert len(files) >= 3 and new.replaces == {1, 2, 3, 4}
    want = sorted([*range(30_000), *range(0, 30_000, 7)])
    assert sorted(r.k for r in engine.sql("SELECT k FROM t").collect()) == want


def test_compactions_at_the_same_time(spark, tmp_path):
    one, two = Engine(spark, str(tmp_path)), Engine(spark, str(tmp_path))
    table = one.create_table(TableSchema.of("t", {"k": "I64"}))
    for k in (1, 2, 3):
        one.insert("t", [(k,)])
    old = table.parts()
    late = two.table("t")
    late._write(late.rows_of(old[:2]), old[:2], {}, None)
    assert table._write(table.rows_of(old), old, {}, None) is None, "its parts are gone"
    parts = {p.id: p for p in table._all()}
    clash = type(old[0])(9, 3, {}, frozenset({1, 2, 3}), {}, 0, True)
    assert [p.id for p in visible([*parts.values(), clash])] == [1, 4]
    assert rows(one, "SELECT k FROM t") == [(1,), (2,), (3,)]


def test_ids_are_given_to_one_writer(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    one, two = Engine(spark, str(tmp_path)), Engine(spark, str(tmp_path))
    one.create_table(TableSchema.of("t", {"k": "I64"}))
    assert one.table("t").files.claim("t/claim") and not two.table("t").files.claim("t/claim")
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda k: (one if k % 2 else two).table("t").insert(spark.range(k, k + 1)), range(12)))
    assert len({p.id for p in got}) == 12 and rows(one, "SELECT k FROM t") == [(k,) for k in range(12)]


def test_snapshots_copy_manifests(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(parts_module, "LOOSE", 3)
    engine = Engine(spark, str(tmp_path), strict=True)
    table = engine.create_table(TableSchema.of("t", {"k": "I64", "x": "F64"}))
    for k in range(7):
        engine.insert("t", [(k, float("nan") if k == 2 else k / 3)])
    assert max(map(int, table.files.names("t/_snapshots"))) >= 6
    for i in (2, 3):
        table.files.write(f"t/part_0000{i}/{MANIFEST}", "{")
    again = Engine(spark, str(tmp_path), strict=True)
    assert again.table("t").parts() == table.parts()
    assert {f.rsplit("/", 2)[1] for f in again.sql("SELECT k FROM t WHERE k = 2").inputFiles()} == {"part_00003"}


def test_default_mode_reads_the_parts_that_the_plan_needs(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    engine.create_table(TableSchema.of("t", {"k": "I64", "b": "I8", "x": "F32", "u": "U64"}, (0,)))
    engine.create_table(TableSchema.of("other", {"k": "I64"}))
    for low in (0, 10, 20, 30):
        engine.insert("t", spark.range(low, low + 10).selectExpr("id", "id", "id / 4", "id"))
    engine.insert("other", spark.range(40))
    for sql, want in [
        ("SELECT k FROM t WHERE k < 5", 1), ("SELECT k FROM t WHERE (k < 5) ORDER BY k", 1), ("SELECT COUNT(*) FROM t WHERE k BETWEEN 12 AND 25", 2),
        ("SELECT k + 1 FROM t WHERE k IN (3, 35)", 2), ("SELECT k FROM t WHERE k < 5 AND abs(x) > 0", 1), ("SELECT k FROM t WHERE abs(k) < 5", 4),
        ("SELECT k FROM t WHERE k < 5 OR abs(x) > 3", 4), ("SELECT k FROM t WHERE b = 31 LIMIT 3", 1), ("SELECT k FROM t WHERE x >= 7.5", 1), ("SELECT k FROM t WHERE u > 29", 1),
        ("SELECT K FROM T WHERE NOT k >= 10", 1), ("SELECT k FROM (SELECT k, x FROM t) v WHERE k = 11", 1), ("WITH c AS (SELECT * FROM t) SELECT a.k FROM c a JOIN c b USING (k) WHERE k = 11", 1),
        ("SELECT k FROM t WHERE k = (SELECT MAX(k) FROM t)", 4), ("SELECT k FROM t WHERE k < 10 UNION ALL SELECT k FROM t WHERE k >= 30", 2), ("SELECT k FROM t WHERE k <> 3 AND k < 10", 1),
        ("SELECT t.k FROM t LEFT JOIN other ON t.k = other.k WHERE t.k > 30", 1),
    ]:
        df = engine.sql(sql)
        assert len({f.rsplit("/", 2)[1] for f in df.inputFiles() if "/t/" in f}) == want, sql
        everything = engine.table("t").scan()
        everything.createOrReplaceTempView("t")
        assert sorted(map(tuple, df.collect())) == sorted(map(tuple, engine.spark.sql(sql).collect())), sql


def test_inserts_in_default_mode(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    engine.create_table(TableSchema.of("t", {"k": "I8", "s": "Str"}))
    engine.execute("INSERT INTO t VALUES (-1, 'a;b'), (1 + 1, concat('x', 'y'));")
    engine.execute("INSERT INTO t (S, `k`) SELECT s, k * 10 FROM t")
    engine.execute("insert into t (SELECT CAST(k AS BIGINT), s FROM t WHERE k < -5)")
    assert rows(engine, "SELECT k, s FROM t") == [(-10, "a;b"), (-10, "a;b"), (-1, "a;b"), (2, "xy"), (20, "xy")]
    for bad in ("INSERT INTO t SELECT k FROM t", "INSERT INTO t VALUES ('1', 'a')", "INSERT INTO t (k, k) VALUES (1, 2)", "INSERT INTO t VALUES (1000, 'a')", "INSERT INTO t VALUES (NULL, 'a')", "INSERT INTO t VALUES (1.5, 'a')"):
        with pytest.raises(ValueError):
            engine.execute(bad)
    strict = Engine(spark, str(tmp_path), strict=True)
    for bad in ("INSERT INTO t VALUES (-1, 'a')", "INSERT INTO t SELECT k, s FROM t"):
        with pytest.raises(DialectError):
            strict.execute(bad)


@pytest.mark.parametrize("sql,kind,keeps", [
    ("1.0000001D", "I32", None), ("CAST('1.0000001' AS DECIMAL(20,10))", "I32", None), ("'1.0000001'", "I32", None), ("'7'", "I32", 7), ("' -7.0'", "I8", -7), ("2147483648D", "I32", None),
    ("9223372036854774784D", "I64", 9223372036854774784), ("9223372036854775808D", "I64", None), ("18446744073709549568D", "U64", Decimal(18446744073709549568)), ("18446744073709551616D", "U64", None),
    ("-1D", "U64", None), ("double('NaN')", "I64", None), ("1e300D", "F32", None), ("double('Infinity')", "F32", math.inf), ("0.1D", "F32", 0.10000000149011612), ("CAST(1e20 AS DECIMAL(38,0))", "I64", None), ("true", "I8", 1),
])
def test_values_are_kept_or_rejected(spark, tmp_path, sql, kind, keeps):
    engine = Engine(spark, str(tmp_path))
    engine.create_table(TableSchema.of("t", {"v": kind}))
    one = spark.sql(f"SELECT {sql}")
    if keeps is None:
        with pytest.raises(ValueError, match="out of its column's range"):
            engine.insert("t", one)
    else:
        engine.insert("t", one)
        assert rows(engine, "SELECT v FROM t") == [(keeps,)]


@pytest.mark.parametrize("literal", ["1e99999999", "1e-99999999", "1e9999999999999999999", "9" * 5000])
def test_huge_literals_are_errors_at_once(small, literal):
    with pytest.raises(DialectError):
        small.sql(f"SELECT ts FROM wide WHERE ts < {literal}")
    if len(literal) < 20:
        assert small.sql(f"SELECT ts FROM wide WHERE f32_c < {literal}").count() == (0 if "-" in literal else 6)


def test_query_statistics(many):
    rows_, s = many.measure("SELECT ts FROM wide WHERE ts < 700")
    assert (rows_.num_rows, s.rows, s.parts, s.parts_read, s.rows_read) == (700, 700, len(SIZES), 1, 700) and s.bytes_read > 0 and s.seconds > 0
    _, s = many.measure("SELECT COUNT(ts) FROM wide WHERE ts < 0")
    assert (s.rows, s.parts_read, s.rows_read, s.bytes_read) == (1, 0, 0, 0)


def test_encoding_by_column(spark, tmp_path):
    import pyarrow.parquet as pq

    engine = Engine(spark, str(tmp_path))
    engine.create_table(TableSchema.of("t", {"k": "I64", "v": "I64"}))
    engine.insert("t", spark.range(5000).coalesce(1).selectExpr("id", "id % 7"), options={"parquet.enable.dictionary#k": "false"})
    group = pq.ParquetFile(next((tmp_path / "t" / "part_00001").glob("*.parquet"))).metadata.row_group(0)
    assert not any("DICTIONARY" in e for e in group.column(0).encodings) and any("DICTIONARY" in e for e in group.column(1).encodings)


def test_delta_encoding(spark, tmp_path):
    import pyarrow.parquet as pq

    engine = Engine(spark, str(tmp_path))
    engine.create_table(TableSchema.of("t", {"k": "I64"}))
    engine.insert("t", spark.range(100_000).coalesce(1), options={"parquet.writer.version": "v2", "parquet.enable.dictionary": "false"})
    column = pq.ParquetFile(next((tmp_path / "t" / "part_00001").glob("*.parquet"))).metadata.row_group(0).column(0)
    assert "DELTA_BINARY_PACKED" in column.encodings and column.total_compressed_size < 100_000


@pytest.mark.parametrize("compression", ["lz4_raw", "none"])
def test_writer_options(spark, tmp_path, compression):
    import pyarrow.parquet as pq

    engine = Engine(spark, str(tmp_path))
    engine.create_table(TableSchema.of("t", {"k": "I64"}))
    engine.insert("t", spark.range(2000), options={"compression": compression, "parquet.writer.version": "v2"})
    column = pq.ParquetFile(next((tmp_path / "t" / "part_00001").glob("*.parquet"))).metadata.row_group(0).column(0)
    assert column.compression == {"lz4_raw": "LZ4", "none": "UNCOMPRESSED"}[compression]
    assert engine.sql("SELECT COUNT(*) FROM t").first()[0] == 2000


def test_replaced_parts_are_invisible_before_they_are_deleted(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    table = engine.create_table(TableSchema.of("t", {"k": "I64"}))
    engine.insert("t", [(1,)])
    table._write(table.scan(), table.parts(), {}, None)
    assert rows(engine, "SELECT k FROM t") == [(1,)]
    table.files.write(f"t/merged_00002/{MANIFEST}", "{")
    with pytest.raises(ValueError):
        Engine(spark, str(tmp_path)).table("t").parts()


def test_catalog(spark, tmp_path):
    schema = TableSchema.of("events", {"timestamp": "I64", "user_id": "U32", "is_active": "Bool", "label": "Str"}, (0, 1))
    assert TableSchema.from_json(schema.to_json()) == schema
    engine = Engine(spark, str(tmp_path))
    engine.create_table(schema)
    assert Engine(spark, str(tmp_path)).table("events").schema == schema
    with pytest.raises(ValueError, match="exists"):
        engine.create_table(schema)
    for bad in ({"name": "x", "columns": [{"name": "a", "data_type": "Date"}]}, {"name": "x", "columns": [], "sort_key": [0]}):
        with pytest.raises(ValueError):
            TableSchema.from_json(__import__("json").dumps(bad))


def test_default_mode_is_spark_sql(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    engine.create_table(TableSchema.of("a", {"k": "I64", "v": "F64"}))
    engine.create_table(TableSchema.of("b", {"k": "I64", "w": "Str"}))
    engine.execute("INSERT INTO a VALUES (1, 0.5), (2, 1.5)")
    engine.execute("INSERT INTO b VALUES (2, 'two')")
    assert rows(engine, "SELECT w, v * 2 FROM a JOIN b USING (k) ORDER BY 1") == [("two", 3.0)]
    assert rows(engine, "SELECT K FROM a WHERE v > 1") == [(2,)]
    assert "Scan parquet" in engine.explain("SELECT k FROM a WHERE k > 1")


def test_prompt(spark, tmp_path):
    from lamina.cli import Prompt

    engine, said = Engine(spark, str(tmp_path), strict=True), []
    engine.create_table(TableSchema.of("t", {"k": "I64"}))
    prompt = Prompt(engine, said.append)
    for line in ("INSERT INTO t VALUES (1), (2)", "SELECT k FROM t WHERE k = 2", "SELECT k FROM t WHERE k = 3", "DELETE FROM t"):
        assert not prompt.onecmd(line)
    assert said[0] == "OK (2 rows inserted, part_00001)" and "2" in said[2] and said[3].startswith("(1 rows in") and said[5] == "(0 rows)" and said[7].startswith("error:")
    assert prompt.onecmd("EOF")


def test_streams(spark, tmp_path):
    from lamina.streaming.ingest import stream_from, stream_into

    engine = Engine(spark, str(tmp_path / "tables"))
    engine.create_table(TableSchema.of("t", {"k": "I64"}))
    source = str(tmp_path / "in")
    spark.range(5).write.parquet(source)
    for _ in range(2):
        query = stream_into(engine, "t", engine.spark.readStream.schema("id long").parquet(source), str(tmp_path / "check"))
        query.awaitTermination()
    assert rows(engine, "SELECT k FROM t") == [(k,) for k in range(5)]
    again = engine.table("t").insert(spark.range(5), batch=f"{tmp_path / 'check'}#0")
    assert again is None
    spark.range(5, 7).write.mode("append").parquet(source)
    stream_into(engine, "t", engine.spark.readStream.schema("id long").parquet(source), str(tmp_path / "check")).awaitTermination()
    engine.compact("t")
    for number in (0, 1):
        assert engine.table("t").insert(spark.range(5), batch=f"{tmp_path / 'check'}#{number}") is None, "compacted, but published"
    engine.insert("t", [(9,)])
    out = stream_from(engine, "t").writeStream.format("memory").queryName("out").trigger(availableNow=True).start()
    out.awaitTermination()
    assert sorted(r.k for r in engine.spark.table("out").collect()) == [0, 1, 2, 3, 4, 5, 6, 9]
    engine.table("t").vacuum(retention=0)
    with pytest.raises(ValueError, match="would miss"):
        stream_from(engine, "t")
    assert stream_from(engine, "t", resumed=True).isStreaming
