"""Scans and sinks: forms of files, and what must be refused."""

import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tessella.sources import json_split, scans, sinks


def put(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False), encoding="utf-8")
    return str(path)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_json_forms(spark, tmp_path):
    a = put(tmp_path / "a.json", [{"id": "1", "q": "ü"}, {"id": "2", "q": None}])
    assert rows(scans.json_array(spark, a, "id string, q string").filter("q is not null")) == [("1", "ü")]
    nested = put(tmp_path / "n.json", [{"questions": [{"qid": "x"}, {"qid": "y"}]}])
    assert rows(scans.json_array(spark, nested, "questions array<struct<qid string>>", "questions")) == [("x",), ("y",)]
    m = put(tmp_path / "m.json", {"k1": {"QUESTION": "q", "final": "yes"}, "k2": {"QUESTION": "p", "final": "no"}})
    assert rows(scans.json_map(spark, m, "QUESTION string, final string")) == [("k1", "q", "yes"), ("k2", "p", "no")]
    bad = put(tmp_path / "bad.json", '[{"id": "3", "q"')
    assert rows(scans.union_files(spark, [a, bad, str(tmp_path / "none.json")], "id string, q string").select("id", "file_index")) == [("1", 0), ("2", 0)]
    assert scans.records(spark, a, "id string, q string").count() == 2


def test_json_lines(spark, tmp_path):
    good = put(tmp_path / "g.jsonl", '{"id": "ü1", "t": "a"}\n{"id": "2", "t": "b"}\n')
    cut = put(tmp_path / "c.jsonl", '{"id": "1", "t": "a"}\n{"id": "2", "t"')
    blank = put(tmp_path / "b.jsonl", '{"id": "1", "t": "a"}\n\n{"t": "c"}\n[1]\n')
    ddl = "id string, t string"
    assert rows(scans.jsonl(spark, good, ddl)) == [("2", "b"), ("ü1", "a")]
    for path in (cut, blank):
        with pytest.raises(Exception, match="not a JSON object"):
            scans.jsonl(spark, path, ddl).collect()
    with pytest.raises(Exception, match="not a JSON object"):
        scans.jsonl(spark, cut, ddl, "lenient").collect()
    assert scans.jsonl(spark, blank, ddl, "any").count() == 2 and scans.jsonl(spark, cut, ddl, "any").count() == 1
    many = put(tmp_path / "many.jsonl", "\n\n".join(json.dumps({"t": str(i)} if i % 2 else {"id": f"x{i}", "t": str(i)}) for i in range(20)))
    got = scans.jsonl_slice(spark, many, ddl, 3, 4).orderBy("index").collect()
    assert [(r["index"], r["id"]) for r in got] == [(3, "3"), (4, "x4"), (5, "5"), (6, "x6")]


def test_tables_and_paths(spark, tmp_path):
    t = put(tmp_path / "p.tsv", 'id\ttext\ttitle\n1\t"a\tb"\tT\n2\tplain\tU\n')
    assert rows(scans.tsv(spark, t)) == [("1", "a\tb", "T"), ("2", "plain", "U")]
    assert [p.rsplit("/", 1)[1] for p in scans.expand(spark, str(tmp_path / "*.tsv"))] == ["p.tsv"]
    with pytest.raises(FileNotFoundError):
        scans.expand(spark, str(tmp_path / "*.none"))
    assert scans.existing(spark, f"{t}, {tmp_path}/gone.tsv") == [t]
    y = put(tmp_path / "c.yaml", "a: 1  # one\nb: 'x'\n# c: 3\n")
    assert scans.config(spark, y, {"b": 2, "d": 4}) == {"a": 1, "b": 2, "d": 4}
    deep = """# a run
model:
  name: "x: #1"   # quoted
  sizes: [1, 2, three]
  nested: {k: v, n: 2}
  none: ~
stages:
- kind: read
  path: s3://b/c
- kind: rank
  options:
    top: 3
    on: True
plain: it's here # comment
single: 'it''s'
lists:
  -
    - 1
    - 2.5
  - last
"""
    want = {"model": {"name": "x: #1", "sizes": [1, 2, "three"], "nested": {"k": "v", "n": 2}, "none": None}, "stages": [{"kind": "read", "path": "s3://b/c"}, {"kind": "rank", "options": {"top": 3, "on": True}}], "plain": "it's here", "single": "it's", "lists": [[1, 2.5], "last"]}
    assert scans.config(spark, put(tmp_path / "deep.yaml", deep)) == want
    for bad in ("a: 1\n   b: 2\n", "a:\n    b: 1\n  c: 2\n", "no key\n"):
        with pytest.raises(ValueError):
            scans.config(spark, put(tmp_path / "bad.yaml", bad))
    df = spark.createDataFrame([("1", '"Title"\nbody\nmore'), ("2", "alone")], "id string, contents string")
    assert rows(scans.passages(df)) == [("1", "Title", "body\nmore"), ("2", "alone", "")]


def test_bundles(spark, tmp_path):
    for d, names in (("one", (2, 1)), ("two", (3,)), ("three", (1,))):
        (tmp_path / d).mkdir()
        for i in names:
            put(tmp_path / d / f"sample_{i}.json", {"sample_index": i, "qid": f"q{i}"})
    ddl, keys = "sample_index long, qid string", ["sample_index", "qid"]
    assert [r[0] for r in scans.bundles(spark, [f"{tmp_path}/one", f"{tmp_path}/two"], ddl, keys).collect()] == [1, 2, 3]
    with pytest.raises(ValueError, match="more than once"):
        scans.bundles(spark, [f"{tmp_path}/one", f"{tmp_path}/three"], ddl, keys)


def test_polymorphic_columns(spark):
    payloads = ['{"rows": [{"row": {"q": "a"}}, {"row": {"q": "b"}}]}', '{"data": [{"q": "c"}]}', '[{"q": "d"}]']
    df = spark.createDataFrame([(p,) for p in payloads], "p string")
    assert rows(df.select(F.inline(scans.gold_rows(F.col("p"), "q: string")))) == [("a",), ("b",), ("c",), ("d",)]
    for bad in ('{"x": 1}', '{"rows": [{"no": 1}]}'):
        with pytest.raises(Exception, match="unknown gold format|row is missing"):
            spark.createDataFrame([(bad,)], "p string").select(scans.gold_rows(F.col("p"), "q: string")).collect()
    forms = ['{"title": ["A"], "sentences": [["x", "y"]]}', '[["A", ["x", "y"]]]']
    df = spark.createDataFrame([(p,) for p in forms], "p string")
    assert [r["sentences"] for r in df.select(F.inline(scans.context_pairs(F.col("p")))).collect()] == [["x", "y"]] * 2
    for bad in ('{"title": ["A", "B"], "sentences": [["x"]]}', '[["A"]]', "1"):
        with pytest.raises(Exception, match="differ in number|pair|no context"):
            spark.createDataFrame([(bad,)], "p string").select(scans.context_pairs(F.col("p"))).collect()
    df = spark.createDataFrame([("{'a': 'ü', 'n': None}",), ('{"b": 1}',), ("nothing",), (None,)], "m string")
    assert [json.loads(r[0]) for r in df.select(scans.metadata_json("m")).collect()] == [{"a": "ü", "n": None}, {"b": 1}, {}, {}]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, aa string")
    sinks.create_jsonl(df, f"{tmp_path}/x")
    with pytest.raises(Exception, match="already exists"):
        sinks.create_jsonl(df, f"{tmp_path}/x")
    sinks.append_jsonl(df, f"{tmp_path}/x")
    lines = [r[0] for r in spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(f"{tmp_path}/x").collect()]
    assert len(lines) == 4 and '{"aa":null,"id":2}' in lines
    assert sinks.write_layers({"states": df}, f"{tmp_path}/run") == sinks.write_layers({"states": df}, f"{tmp_path}/run") == {"states": 2}
    with pytest.raises(ValueError, match="has 2 rows"):
        sinks.write_layers({"states": df.limit(1)}, f"{tmp_path}/run")
    sinks.write_result(spark.createDataFrame([("EM", 0.5)], "metric string, value double"), f"{tmp_path}/r.tsv")
    assert spark.read.text(f"{tmp_path}/r.tsv").first()[0] == "EM,0.5"
    sinks.guard_config({"a": 1, "t": 1}, {"a": 1, "t": 2}, ("t",))
    with pytest.raises(ValueError, match="changed"):
        sinks.guard_config({"a": 1}, {"a": 1, "b": None})
    assert [sinks.free_run_dir(spark, f"{tmp_path}/runs")[-1] for _ in range(2)] == ["0", "1"]


def test_corpora_and_shards(spark, tmp_path):
    base = spark.createDataFrame([("1", "h1")], "id string, hash string")
    new = spark.createDataFrame([("3", "h2"), ("2", "h2"), ("4", "h1"), ("5", "h3")], "id string, hash string")
    assert rows(sinks.extend_corpus(base, new, f"{tmp_path}/c")) == [("2", "h2"), ("5", "h3")]
    assert spark.read.parquet(f"{tmp_path}/c/all").count() == 3
    assert sinks.pending(new, f"{tmp_path}/none", "id").count() == 4 and rows(sinks.pending(new, f"{tmp_path}/c/all", "id").select("id")) == [("3",), ("4",)]
    shard = lambda *ids: spark.createDataFrame([(i,) for i in ids], "i long")
    whole = shard(0, 1, 2, 3)
    assert [r[0] for r in sinks.merge_shards({0: shard(2, 0), 1: shard(1, 3)}, "i", whole).collect()] == [0, 1, 2, 3]
    for bad in ({0: shard(0, 1), 1: shard(3)}, {0: shard(0, 0), 1: shard(1)}, {0: shard(None), 1: shard(1)}, {0: shard(0), 1: shard(1)}, {0: shard(0, 2, 4), 1: shard(1, 3)}):
        with pytest.raises(ValueError, match="shard|twice"):
            sinks.merge_shards(bad, "i", whole)


def test_committed_json_lines(spark, tmp_path):
    df = spark.createDataFrame([(1, "b"), (2, None)], "k long, a string")
    at = f"{tmp_path}/log"
    assert [sinks.append_jsonl(df, at), sinks.append_jsonl(df.limit(1), at)] == [0, 1]
    assert sinks.read_jsonl(spark, at, "a string, k long").count() == 3
    broken = df.withColumn("a", F.when(F.col("k") == 2, F.raise_error(F.lit("no"))).otherwise(F.col("a")))
    with pytest.raises(Exception, match="no"):
        sinks.append_jsonl(broken, at)
    assert sinks.read_jsonl(spark, at, "a string, k long").count() == 3
    with ThreadPoolExecutor(8) as pool:  # numbers of their own
        assert sorted(pool.map(lambda _: sinks.append_jsonl(df, at), range(4))) == [2, 3, 4, 5]
    assert sinks.read_jsonl(spark, at, "a string, k long").count() == 11


def test_one_writer_wins(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "k long")

    def create(_):
        try:
            sinks.create_jsonl(df, f"{tmp_path}/once")
        except FileExistsError:
            return 0
        return 1

    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(create, range(8))) == 1
        assert sinks.read_jsonl(spark, f"{tmp_path}/once", "k long").count() == 1
        assert sorted(int(p.rsplit("/", 1)[1]) for p in pool.map(lambda _: sinks.free_run_dir(spark, f"{tmp_path}/many"), range(8))) == list(range(8))


RECORD = "id long, q string, inner array<struct<a string>>"


def hard(i):
    return {"id": i, "q": ["plain", 'brace } and { in "quotes"', "back\\\\slash }", 'ends in quote\\"', "ü日本 \n }{", ""][i % 6] + "x" * (i % 37), "inner": [{"a": "}"}, {"a": None}][: i % 3]}


@pytest.mark.parametrize(("size", "indent"), [("300", None), ("300", 1), ("2000", None), ("100m", None)])
def test_split_json(spark, tmp_path, size, indent):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        files = []
        for k in range(2):
            records = [hard(i) for i in range(k * 300, k * 300 + 300)]
            files.append(put(tmp_path / f"a{k}.json", json.dumps(records, ensure_ascii=False, indent=indent)))
        got = json_split.json_array(spark, files, RECORD)
        if size == "300":
            assert spark.read.option("lineSep", "}").text(files).rdd.getNumPartitions() > 4
        plain = spark.read.schema(RECORD).option("multiLine", True).json(files)
        assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect())) and got.count() == 600
        m = put(tmp_path / "m.json", json.dumps({f'k"{i}}}': hard(i) for i in range(200)}, indent=indent))
        assert sorted(map(str, json_split.json_map(spark, m, RECORD).collect())) == sorted(map(str, scans.json_map(spark, m, RECORD).collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_split_json_odd(spark, tmp_path):
    none = put(tmp_path / "none.json", " [ ]\n")
    assert json_split.json_array(spark, none, RECORD).count() == 0
    assert json_split.json_map(spark, put(tmp_path / "nomap.json", "{}"), RECORD).count() == 0
    one = put(tmp_path / "one.json", '{"questions": [{"a": "x"}, {"a": "}"}]}')
    assert rows(json_split.json_array(spark, one, "questions array<struct<a string>>", "questions")) == [("x",), ("}",)]
    for bad, said in (('[{"id": 1}, {"id": 2, "q": "', "cut JSON"), ('[{"id": 1}, 7, {"id": 2}]', "not a JSON object"), ('[{"id": "x"}]', "")):
        with pytest.raises(Exception, match=said):
            json_split.json_array(spark, put(tmp_path / "bad.json", bad), RECORD).collect()
