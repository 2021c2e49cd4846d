"""The public surface over small files of every format."""

import os

import pyarrow as pa
import pytest

import fixtures as fx
from quarrylake import api
from quarrylake.errors import QueryError, RuleError, UnsupportedFormat
from quarrylake.operators import discovery, lake, lakemap
from quarrylake.operators.rules import parse_rule
from quarrylake.sources import readers, registry


@pytest.fixture
def engine(spark):
    return api.AuditEngine(spark=spark)


def _write(spark, kind, tmp_path):
    if kind in ("csv", "psv", "txt", "tsv"):
        return fx.delimited(tmp_path / f"t.{kind}", {"csv": ",", "psv": "|", "txt": ";", "tsv": "\t"}[kind])
    if kind == "json":
        (tmp_path / "t.json").write_text("[\n" + ",\n".join(str(d).replace("'", '"') for d in fx.DICTS) + "\n]")
    elif kind == "jsonl":
        (tmp_path / "t.jsonl").write_text("[" + ",".join(str(d).replace("'", '"') for d in fx.DICTS) + "]")
    elif kind == "ndjson":
        (tmp_path / "t.ndjson").write_text("\n".join(str(d).replace("'", '"') for d in fx.DICTS))
    elif kind in ("parquet", "pq"):
        import pyarrow.parquet as pq

        pq.write_table(pa.Table.from_pylist(fx.DICTS), tmp_path / f"t.{kind}")
    elif kind == "orc":
        import pyarrow.orc as orc

        orc.write_table(pa.Table.from_pylist(fx.DICTS), str(tmp_path / "t.orc"))
    elif kind in ("feather", "arrow", "ipc"):
        return fx.arrow(tmp_path / f"t.{kind}")
    else:
        return getattr(fx, kind)(tmp_path / f"t.{kind}")
    return str(tmp_path / f"t.{kind}")


TYPED = ["csv", "psv", "txt", "json", "jsonl", "ndjson", "parquet", "pq", "orc", "feather", "arrow", "ipc", "avro", "msgpack"]


@pytest.mark.parametrize("kind", TYPED)
def test_golden_counts(spark, engine, tmp_path, kind):
    assert engine.process_file(_write(spark, kind, tmp_path)) == (6, 2, 4)


@pytest.mark.parametrize("kind", ["tsv", "xlsx"])
def test_text_formats_skip_typed_checks(spark, engine, tmp_path, kind):
    path = _write(spark, kind, tmp_path)
    assert engine.process_file(path) == (6, 6, 0)
    assert set(dict(readers.read_file(spark, path).dtypes).values()) == {"string"}


def test_static_codes(spark, engine, tmp_path):
    from quarrylake.operators import audit

    df = readers.read_file(spark, fx.delimited(tmp_path / "t.csv", ","))
    assert [r["audit_error_code"] for r in audit.flag_static(df).collect()] == [0, 2, 1, 0, 1, 6]


@pytest.mark.parametrize("options,want", [({"min_passenger": 0}, (6, 3, 3)), ({"min_passenger": 0, "max_passenger": 20}, (6, 4, 2)), ({"min_passenger": 50, "max_passenger": 1}, (6, 0, 6))])
def test_thresholds(spark, tmp_path, options, want):
    assert api.AuditEngine(spark=spark, **options).process_file(fx.delimited(tmp_path / "t.csv", ",")) == want


def test_batch_sizes_and_errors(spark, engine, tmp_path):
    path = fx.delimited(tmp_path / "t.csv", ",")
    assert engine.process_file(path, 10**12) == (6, 2, 4)
    assert engine.process_file(path, 0) == (0, 0, 0)
    with pytest.raises(OverflowError):
        engine.process_file(path, -5)
    with pytest.raises(UnsupportedFormat):
        engine.process_file(str(tmp_path / "t.unknown"))
    with pytest.raises(OSError):
        engine.process_file(str(tmp_path / "none.csv"))
    with pytest.raises(TypeError):
        engine.process_file(5)
    with pytest.raises(RuleError):
        engine.filter_matrix(path, ["fare_amount = 3"])


def test_filter_matrix(spark, engine, tmp_path):
    clean, trash = engine.filter_matrix(fx.delimited(tmp_path / "t.csv", ","), ["fare_amount > 0"])
    assert (clean.num_rows, trash.num_rows) == (4, 2)
    for kind in ("json", "orc"):
        clean, trash = engine.filter_matrix(_write(spark, kind, tmp_path), ["passenger_count > 3"])
        assert (clean.num_rows, trash.num_rows) == (2, 4)


def test_process_batch(spark, engine):
    batch = pa.RecordBatch.from_pylist(fx.DICTS)
    clean, trash = engine.process_batch(batch)
    assert (clean.num_rows, trash.num_rows) == (2, 4)
    with pytest.raises(TypeError):
        engine.process_batch([1, 2])


@pytest.mark.parametrize("kind", ["csv", "parquet", "avro", "msgpack", "xlsx"])
def test_slices(spark, engine, tmp_path, kind):
    path = _write(spark, kind, tmp_path)
    got = engine.slice_rows(path, 1, 2).column("passenger_count").to_pylist()
    assert [int(x) for x in got] == [2, 0]
    assert engine.slice_rows(path, 99, 5).num_rows == 0
    assert engine.slice_rows(path, 0, 0).num_rows == 0
    assert engine.slice_cols(path, ["trip_distance", "fare_amount"], 0, 1).column_names == ["trip_distance", "fare_amount"]
    with pytest.raises(OSError):
        engine.slice_cols(path, ["nope"], 0, 1)


def test_preview(spark, engine, tmp_path):
    clean, trash = engine.preview_sample(fx.delimited(tmp_path / "t.csv", ","), 2)
    assert (clean.num_rows, trash.num_rows) == (1, 1)


def test_first_rows_of_a_folder(spark, engine, tmp_path):
    for i, n in enumerate((3, 50_000, 4)):  # Spark reads the largest file first
        for kind in ("parquet", "orc", "csv"):
            rows = spark.range(1_000_000 * i, 1_000_000 * i + n, numPartitions=1).selectExpr("int(id) as passenger_count", "1.0D as fare_amount", "1.0D as trip_distance")
            lake.write_file(spark, rows, f"{tmp_path}/t.{kind}/{i}.{kind}", kind) if kind != "orc" else rows.coalesce(1).write.mode("append").orc(f"{tmp_path}/t.orc/{i}")
    numbers = lambda *sides: sorted(x for t in sides for x in t.column("passenger_count").to_pylist())
    for kind in ("parquet", "orc", "csv"):
        assert numbers(*engine.preview_sample(f"{tmp_path}/t.{kind}", 5)) == [0, 1, 2, 1_000_000, 1_000_001], kind
    path = f"{tmp_path}/t.parquet"
    assert engine.slice_rows(path, 2, 3).column("passenger_count").to_pylist() == [2, 1_000_000, 1_000_001]
    assert engine.slice_rows(path, 50_002, 9).column("passenger_count").to_pylist() == [1_049_999, 2_000_000, 2_000_001, 2_000_002, 2_000_003]
    assert engine.slice_rows(path, 50_007, 9).num_rows == engine.slice_rows(path, 1, 0).num_rows == 0


def test_avro_codecs_and_nullable(spark, tmp_path):
    rows = [*fx.DICTS, dict.fromkeys(fx.NAMES)]
    for codec in ("null", "deflate"):
        got = readers.read_file(spark, fx.avro(tmp_path / f"{codec}.avro", rows, codec, nullable=True)).collect()
        assert [tuple(r) for r in got] == [*fx.TAXI, (None, None, None)]


def test_msgpack_leading_values_are_dropped(spark, tmp_path):
    assert readers.read_file(spark, fx.msgpack(tmp_path / "a.msgpack", lead=b"\x07")).count() == 6
    (tmp_path / "b.msgpack").write_bytes(open(fx.msgpack(tmp_path / "a.msgpack"), "rb").read() + b"\x05\xd3\x00")
    assert readers.read_file(spark, str(tmp_path / "b.msgpack")).where("passenger_count is null").count() == 1


def test_empty_files(spark, engine, tmp_path):
    for kind in ("csv", "ndjson", "json"):
        (tmp_path / f"e.{kind}").write_text("")
        assert engine.process_file(str(tmp_path / f"e.{kind}")) == (0, 0, 0)


def test_json_object_is_one_row(spark, engine, tmp_path):
    (tmp_path / "o.json").write_text('{\n "a": 1,\n "b": {"c": 2}\n}')
    assert engine.slice_rows(str(tmp_path / "o.json"), 0, 5).num_rows == 1


@pytest.mark.parametrize("first,want", [(b"PAR1x", "parquet"), (b"ARROW1\0", "arrow"), (b"PK\x03\x04", "xlsx"), (b"Obj\x01", "avro"), (b"ORCx", "orc"), (b"\x83\xa2id", "msgpack"), (b"  [1", "json"), (b'{"a":1}', "ndjson"), (b"a\tb\n", "tsv"), (b"a|b\n", "psv"), (b"a;b\n", "txt"), (b"a,b\n", "csv"), (b"", None), (b"word", None)])
def test_sniff(first, want):
    assert registry.sniff(first) == want


def test_files_without_extension(spark, engine, tmp_path):
    (tmp_path / "plain").write_text("id,name,val\n1,a,10.5\n2,b,20.5\n3,c,30.5\n")
    path = str(tmp_path / "plain")
    assert engine.slice_rows(path, 0, 2).num_rows == 2
    assert engine.execute_sql(f"SELECT * FROM '{path}' WHERE val > 15").num_rows == 2


def test_own_formats(spark, engine, tmp_path):
    (tmp_path / "p.pipes").write_text("id|name|age|salary\n1|a|20|5\n2|b|10|6\n3|c|30|7\n")
    path = str(tmp_path / "p.pipes")
    api.formats.register_delimited("pipes", "|")
    try:
        assert "pipes" in api.formats.list_formats()
        assert (engine.slice_rows(path, 0, 2).num_rows, engine.slice_rows(path, 0, 2).num_columns) == (2, 4)
        clean, trash = engine.filter_matrix(path, ["age >= 18"])
        assert (clean.num_rows, trash.num_rows) == (2, 1)
        assert engine.execute_sql(f"SELECT id FROM '{path}' WHERE salary > 5").num_rows == 2
    finally:
        assert api.formats.unregister_format("pipes")
    assert not api.formats.unregister_format("pipes")
    api.formats.register_delimited("tilde", "~", has_header=False)
    try:
        (tmp_path / "x.tilde").write_text("1~a~ok\n2~b~no\n")
        got = engine.slice_rows(str(tmp_path / "x.tilde"), 0, 5)
        assert got.column_names == ["column_1", "column_2", "column_3"] and got.num_rows == 2
    finally:
        api.formats.unregister_format("tilde")


def test_sql_over_folders(spark, engine, tmp_path):
    fx.delimited(tmp_path / "a.csv", ",", [(1, 25, 1000), (2, 15, 500), (3, 30, 1200)], ("id", "age", "salary"))
    assert engine.execute_sql(f"SELECT id FROM '{tmp_path}' WHERE age > 18 ORDER BY id").column("id").to_pylist() == [1, 3]
    mixed = tmp_path / "mixed"
    mixed.mkdir()
    _write(spark, "csv", mixed)
    _write(spark, "json", mixed)
    assert engine.execute_sql(f"SELECT * FROM '{mixed}' WHERE passenger_count > 3").num_rows == 4


def test_sql_errors_and_streams(spark, engine, tmp_path):
    path = fx.delimited(tmp_path / "t.csv", ",")
    with pytest.raises(QueryError):
        engine.execute_sql(f"SELECT * FROM '{path}' WHERE passenger_count > 99")
    assert engine.execute_sql(f"SELECT * FROM '{path}' WHERE passenger_count > 99", error_on_empty=False).num_rows == 0
    for bad in (f"SELEC * FROM '{path}'", f"SELECT nope FROM '{path}'", "SELECT * FROM '/no/such/file.csv'", "DROP TABLE x", "CREATE VIEW v AS SELECT 1"):
        with pytest.raises(RuntimeError):
            engine.execute_sql(bad)
    stream = engine.execute_sql_stream(f"SELECT * FROM '{path}'")
    assert repr(stream) == "BatchIterator(batches=0, rows=0)"
    assert sum(b.num_rows for b in stream) == 6 and stream.rows == 6
    assert engine.execute_sql_stream(f"SELECT * FROM '{path}' WHERE fare_amount > 1e9").to_pyarrow().num_rows == 0
    # Other literals stay, also one that is a path.
    assert engine.execute_sql(f"SELECT '{path}' AS p, \"fare_amount\" FROM '{path}' x LIMIT 1").column("p").to_pylist() == [path]


def test_sql_cache(spark, engine, tmp_path, monkeypatch):
    path = fx.delimited(tmp_path / "t.csv", ",")
    monkeypatch.setenv("QUARRY_SQL_CACHE", "1")
    count = lambda: engine.execute_sql(f"SELECT COUNT(*) AS n FROM '{path}'").column("n").to_pylist()[0]
    assert count() == 6 and os.path.isdir(tmp_path / ".quarry_cache" / "t.csv.parquet")
    fx.delimited(tmp_path / "t.csv", ",", fx.TAXI[:2])
    os.utime(path, (2e9, 2e9))
    assert count() == 2
    assert len(discovery.data_files(spark, str(tmp_path))) == 1


def test_cell_magic(spark, tmp_path):
    from quarrylake.magic import run_cell

    path = fx.delimited(tmp_path / "t.csv", ",")
    name, table = run_cell(f"out --path {path}", "SELECT COUNT(*) AS n FROM '{path}' WHERE fare_amount > {low}", {"low": 10})
    assert name == "out" and table.column("n").to_pylist() == [4]


def test_filter_files(spark, engine, tmp_path):
    for i, rows in enumerate(([(1, 20, 5), (2, 10, 6)], [(3, 30, 7), (4, 5, 8)])):
        fx.delimited(tmp_path / f"f{i}.csv", ",", rows, ("id", "age", "salary"))
    want = {"total_files": 2, "pruned_dirs": 0, "total_rows": 4, "clean_rows": 2, "trash_rows": 2}
    assert engine.filter_files_parallel(str(tmp_path), ["age >= 18"]) == want
    assert engine.filter_files_parallel(f"{tmp_path}/*.csv", ["age >= 18"], num_threads=2) == want
    # A column that one file lacks counts only against the others.
    fx.delimited(tmp_path / "g.csv", ",", [(1,)], ("id",))
    assert engine.filter_files_parallel(str(tmp_path), ["age >= 18"])["clean_rows"] == 3
    (tmp_path / "x.bin").write_bytes(b"\0\0")
    with pytest.raises(ValueError):
        engine.filter_files_parallel(f"{tmp_path}/*", [])


def test_pruning(spark, engine, tmp_path):
    for y in (2025, 2026):
        folder = tmp_path / f"year={y}" / "month=08"
        folder.mkdir(parents=True)
        fx.delimited(folder / "a.csv", ",", [(1, 20), (2, 10)], ("id", "age"))
    got = engine.filter_files_parallel(str(tmp_path), ["year >= 2026", "month == '8'", "age >= 18"])
    assert got == {"total_files": 1, "pruned_dirs": 1, "total_rows": 2, "clean_rows": 1, "trash_rows": 1}
    found = discovery.prune(spark, str(tmp_path), [], "year=2025")
    assert len(found.files) == 1 and found.pruned == 1
    assert discovery.prune(spark, str(tmp_path), [parse_rule("year > 2030")]).pruned == 2
    assert discovery.prune(spark, str(tmp_path), [], "nothing") == discovery.Found([], 1)
    os.symlink(tmp_path / "year=2025", tmp_path / "link")
    assert len(discovery.data_files(spark, str(tmp_path))) == 2


def _lake(tmp_path):
    import pyarrow.parquet as pq

    lake = tmp_path / "lake"
    (lake / "a" / "b").mkdir(parents=True)
    pq.write_table(pa.Table.from_pylist(fx.DICTS), lake / "a" / "one.parquet")
    pq.write_table(pa.Table.from_pylist(fx.DICTS), lake / "a" / "b" / "two.parquet")
    return lake


def test_lake_writers(spark, engine, tmp_path):
    lake = _lake(tmp_path)
    assert engine.process_and_write_lake(str(lake), str(tmp_path / "clean"), str(tmp_path / "trash")) == (2, 12, 4, 8)
    assert spark.read.parquet(str(tmp_path / "clean/a/b/two.parquet")).count() == 2
    assert "audit_error_code" in spark.read.parquet(str(tmp_path / "trash/a/one.parquet")).columns
    files, rows, manifest = engine.generate_gold_table(str(lake), str(tmp_path / "gold"), "v1")
    assert (files, rows) == (2, 4) and '"version": "v1"' in open(manifest).read()


def test_split(spark, engine, tmp_path):
    path = fx.delimited(tmp_path / "t.csv", ",")
    assert engine.split_file(path, 1, str(tmp_path / "s"), "parquet") == 6
    assert engine.split_file(path, 4, str(tmp_path / "s2"), "csv") == 2
    assert sorted(p.name for p in (tmp_path / "s2").iterdir() if not p.name.startswith(".")) == ["t_part_001.csv", "t_part_002.csv"]
    assert open(tmp_path / "s2/t_part_002.csv").read().splitlines()[1:] == ["12,50.0,1.2", "1,0.0,5.0"]
    with pytest.raises(ValueError):
        engine.split_file(path, 0, str(tmp_path / "s"))
    with pytest.raises(ValueError):
        engine.split_file(path, 2, str(tmp_path / "s"), "xml")


def test_split_keeps_every_column_and_the_order(spark, engine, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    t = pa.table({"id": range(1_000), "part": [str(i % 7) for i in range(1_000)], "__row": [0] * 1_000})
    pq.write_table(t, tmp_path / "t.parquet", row_group_size=90)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "50")
    try:
        assert engine.split_file(str(tmp_path / "t.parquet"), 300, str(tmp_path / "s"), "parquet") == 4
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    got = [pq.read_table(tmp_path / f"s/t_part_{i:03d}.parquet") for i in range(1, 5)]
    assert [x.num_rows for x in got] == [300, 300, 300, 100] and pa.concat_tables(got).to_pydict() == t.to_pydict()


def test_functions_of_other_engines(spark, engine, tmp_path):
    from quarrylake.plans import sqlgate

    before = len(spark.catalog.listTables())
    one = lambda x: sqlgate.query(spark, f"SELECT {x} AS x").first()[0]
    assert one("string_to_array('a.b.c', '.')") == ["a", "b", "c"] and one("string_to_array('a|b', '|')") == ["a", "b"]
    assert one("string_to_array('a', '')") == ["a"]
    assert one("generate_series(5, 1)") == [] and one("generate_series(1, 7, 3)") == [1, 4, 7] and one("generate_series(5, 1, -2)") == [5, 3, 1]
    assert str(one("date_bin(INTERVAL '15' MINUTE, TIMESTAMP_NTZ'2026-01-02 03:44:05')")) == "2026-01-02 03:30:00"
    assert str(one("date_bin(INTERVAL '1' DAY, TIMESTAMP_NTZ'2026-01-02 03:44:05', TIMESTAMP_NTZ'2026-01-01 06:00:00')")) == "2026-01-01 06:00:00"
    path = fx.delimited(tmp_path / "t.csv", ",")
    assert sqlgate.query(spark, f"SELECT * FROM '{path}'").count() == 6
    assert len(spark.catalog.listTables()) == before


def test_csv_guard(spark):
    from quarrylake.operators.csvguard import guard

    cells = ["=cmd|' /C calc'!A0", "+2+2", "@SUM(A1:A2)", "-1+1", "-5.0", "plain", None, "", "-5d", "-inf"]
    got = [r[0] for r in guard(spark.createDataFrame([(c,) for c in cells], "c string")).collect()]
    assert got == ["'" + c if c in cells[:4] or c == "-5d" else c for c in cells]


def test_ingest(spark, engine, tmp_path, monkeypatch):
    src = tmp_path / "src"
    src.mkdir()
    fx.delimited(src / "t.csv", ",")
    fx.msgpack(src / "t.msgpack")
    fx.avro(src / "u.avro")
    assert engine.ingest(str(src), str(tmp_path / "copy")) == (3, 0)
    assert sorted(f for f in os.listdir(tmp_path / "copy") if not f.startswith(".")) == ["t.csv", "t.msgpack", "u.avro"]
    assert engine.ingest(str(src), str(tmp_path / "norm"), True) == (3, 12)
    got = [f for f in sorted(os.listdir(tmp_path / "norm")) if not f.startswith(".")]
    assert got == ["t.msgpack.parquet", "t.parquet", "u.avro"]
    monkeypatch.setenv(api.NORMALIZE, "true")
    assert engine.ingest(str(src), str(tmp_path / "norm2")) == (3, 12)


def test_ingest_gives_files_of_a_table_the_same_types(spark, engine, tmp_path):
    src, goal = tmp_path / "src", tmp_path / "lake"
    for folder in ("t/day=1", "t/day=2", "u", "j"):
        (src / folder).mkdir(parents=True)
    fx.delimited(src / "t/day=1/a.csv", ",", [], ("k", "v"))  # a header, no rows
    fx.delimited(src / "t/day=1/b.csv", ",", [(1, 2), (3, 4)], ("k", "v"))
    fx.delimited(src / "t/day=2/c.csv", ",", [(5, 0.5)], ("k", "v"))
    fx.delimited(src / "u/d.csv", ",", [("x", "y")], ("k", "v"))
    (src / "j/e.json").write_text('{"k": null}\n')
    (src / "j/f.json").write_text('{"k": 7}\n')
    assert engine.ingest(str(src), str(goal), True) == (6, 6)
    got = spark.read.parquet(str(goal / "t"))
    assert [got.schema[c].dataType.simpleString() for c in "kv"] == ["bigint", "double"]
    assert sorted((r.k, r.v) for r in got.collect()) == [(1, 2.0), (3, 4.0), (5, 0.5)]
    assert spark.read.parquet(str(goal / "u")).schema["k"].dataType.simpleString() == "string"
    assert {r.k for r in spark.read.parquet(str(goal / "j")).collect()} == {None, 7}


def test_map_and_doctor(spark, engine, tmp_path):
    lake = _lake(tmp_path)
    assert engine.doctor(str(lake))["status"] == "DRIFT_DETECTED"
    engine.create_map(str(lake))
    assert engine.doctor(str(lake))["status"] == "HEALTHY"
    assert lakemap.totals(lakemap.map_frame(spark, str(lake))).first()["total_rows"] == 12
    fx.delimited(lake / "new.csv", ",")
    os.remove(lake / "a" / "one.parquet")
    fx.arrow(lake / "a" / "b" / "two.parquet.arrow")
    report = engine.doctor(str(lake))
    assert (report["unindexed_files"], report["missing_files"]) == (["a/b/two.parquet.arrow", "new.csv"], ["a/one.parquet"])
    assert engine.doctor(str(lake), auto_heal=True)["status"] == "HEALED"
    assert engine.doctor(str(lake))["status"] == "HEALTHY"
    assert lakemap.recommend_batch_size(1 << 31, 8, 100) == 766958
    with pytest.raises(OSError):
        engine.doctor(str(tmp_path / "none"))


def test_documents(spark, engine, tmp_path):
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"id": [1], "age": [2]}), tmp_path / "users.parquet")
    pq.write_table(pa.table({"id": [1], "user_id": [2]}), tmp_path / "orders.parquet")
    graph = engine.generate_er_graph(str(tmp_path), str(tmp_path / "er.md"))
    assert 'orders }|--|| users : "users_id"' in graph and "bigint id PK" in graph and "bigint user_id FK" in graph
    out = engine.export_data_dictionary_md(str(tmp_path), str(tmp_path / "d.md"))
    assert "| 2 | `user_id` | bigint |" in open(out).read()


def test_union_aligns_by_name(spark):
    a, b = spark.createDataFrame([(1, "x")], "a int, b string"), spark.createDataFrame([(2.5, True)], "a double, c boolean")
    got = readers.union([a, b])
    assert got.columns == ["a", "b", "c"] and [tuple(r) for r in got.collect()] == [(1.0, "x", None), (2.5, None, True)]
    with pytest.raises(OSError):
        readers.union([a, spark.createDataFrame([("q",)], "a string")])


def test_namespaces():
    import quarrylake as q

    assert callable(q.read.slice_rows) and callable(q.lake.doctor) and callable(q.sql.execute_sql_stream)
    assert q.filter.process_file and q.graph.generate_er_graph and q.dictionary.export_data_dictionary_md and q.formats.list_formats()


def test_streaming(spark, tmp_path):
    from quarrylake import streaming

    source = str(tmp_path / "in")
    spark.createDataFrame([(i, float(i)) for i in range(10)], "id long, v double").write.parquet(source)
    stream = spark.readStream.schema("id long, v double").parquet(source)
    q = streaming.split_sink(stream, ["v >= 4"], str(tmp_path / "c"), str(tmp_path / "t"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "c")).count() == 6 and spark.read.parquet(str(tmp_path / "t")).count() == 4
