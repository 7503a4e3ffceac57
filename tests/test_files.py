"""Readers and writers of delimited text, JSON records, Parquet and Arrow."""

import random

import pytest
from pyspark.sql import functions as F

from cairn.sources import delimited, records, writers
from cairn.sources.delimited import Options


def rows(spark, tmp_path, content, options=Options()):
    (tmp_path / "f.csv").write_bytes(content.encode() if isinstance(content, str) else content)
    got = delimited.exact(spark, str(tmp_path / "f.csv"), options).orderBy("pos").collect()
    return [(r["pos"], r["fields"], r["error"]) for r in got]


@pytest.mark.parametrize(
    ("content", "want"),
    [
        ("a,b\nc\n", [["a", "b"], ["c"]]), ("", []), ('""\n\nx', [[""], [""], ["x"]]), ("a,\n", [["a", ""]]), ("a,", [["a", ""]]), ("a\r\nb\r\n", [["a"], ["b"]]),
        ('"a,b"c,d\n', [["a,bc", "d"]]), ('"a""b",x"y\n', [['a"b', 'x"y']]), ('"a\\"b",c\\d\n', [['a"b', "c\\d"]]), ('"two\nlines",x\n', [["two\nlines", "x"]]),
    ],
)
def test_delimited(spark, tmp_path, content, want):
    assert [f for _, f, _ in rows(spark, tmp_path, content)] == want


def test_delimited_positions_and_errors(spark, tmp_path):
    assert [p for p, _, _ in rows(spark, tmp_path, "é,1\n😀,22\nx\n")] == [0, 5, 13]
    assert [p for p, _, _ in rows(spark, tmp_path, b"\xef\xbb\xbfa\nb\n")] == [0, 2]
    assert rows(spark, tmp_path, 'a\n"open')[-1] == (2, None, "UnclosedQuote")
    header = Options(header=True)
    assert rows(spark, tmp_path, "left,right\n1,2\n3\n", header) == [(11, ["1", "2"], None), (15, None, "ParseError")]
    assert rows(spark, tmp_path, "a,A\n1,2\n", header) == [(0, None, "InvalidHeaders")]
    assert [f for _, f, _ in rows(spark, tmp_path, "100.200!150.250!", Options(column=".", record="!"))] == [["100", "200"], ["150", "250"]]
    assert [f for _, f, _ in rows(spark, tmp_path, "1<->2<+>3<->4", Options(column="<->", record="<+>"))] == [["1", "2"], ["3", "4"]]
    with pytest.raises(ValueError):
        Options(column="\n")


def test_delimited_round_trip(spark, tmp_path):
    values = ["a\\b,c", 'a"b', "plain", "", "x\ny", "c\\d", " sp "]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").coalesce(1)
    writers.write_delimited(df, str(tmp_path / "out"))
    got = delimited.exact(spark, str(tmp_path / "out")).select(delimited.column(1), delimited.column(2)).collect()
    assert {int(r[0]): r[1] for r in got} == dict(enumerate(values))
    line = df.select(writers.delimited_line([F.col("v")], Options()).alias("l")).collect()
    assert [r["l"] for r in line][:3] == ['"a\\\\b,c"', '"a\\"b"', "plain"]


def test_split_sizes(spark, tmp_path):
    (tmp_path / "f.csv").write_text("".join(f"{k:03d}\n" for k in range(25)))
    own = delimited.split_sizes(delimited.exact(spark, str(tmp_path / "f.csv")), 10)
    assert [r["size"] for r in own.orderBy("part").collect()] == [12] * 8 + [4]


def test_delimited_in_pieces(spark, tmp_path, monkeypatch):
    """Splits of a few bytes and files with and without a byte-order mark and a last separator are read as the whole text is, and no task gets a file whole."""
    rng = random.Random(2)
    said = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for options in (Options(), Options(record="\r\n", escape='"'), Options(column=";;", record="é")):
        text = "".join(rng.choice(["a", "é", options.column, options.record, options.quote, options.escape, options.quote + options.quote, "\r", "😀b"]) for _ in range(300)) + "x" + options.quote
        for k, (body, mark) in enumerate((text[: rng.randrange(200, len(text))] + end, mark) for end in ("", options.record, options.quote + options.record) for mark in (b"", b"\xef\xbb\xbf")):
            file = tmp_path / f"{ord(options.record[-1])}-{k}.csv"
            file.write_bytes(mark + body.encode())
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(rng.choice([7, 16, 61])))
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            got = [(r["pos"], r["size"], r["fields"], r["error"]) for r in delimited.exact(spark, str(file), options).orderBy("pos").collect()]
            spark.conf.set("spark.sql.files.maxPartitionBytes", said)
            spark.conf.unset("spark.sql.files.openCostInBytes")
            whole, pos = [], 0
            for size, fields, error in delimited.records([body], options):
                whole.append((pos, size, fields, error))
                pos += size
            assert got == whole and pos == len(body.encode())
    said = delimited.exact(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" not in said and "Scan text" in said
    monkeypatch.setattr(delimited, "RECORD", 8)
    assert list(delimited.records(['a,"bcd\n', "efgh\n", '"\n', "x\n"], Options())) == [(14, None, "RecordTooLarge")]
    assert list(delimited.records(['a,"bcd\n', "efgh\n"], Options())) == [(12, None, "UnclosedQuote")]
    assert list(delimited.records(["1,2\n", "123456789\n"], Options())) == [(4, ["1", "2"], None), (10, None, "RecordTooLarge")]


def test_split_sizes_out_of_order(spark):
    """Records in any order and of several files; batches go on over runs."""
    rng, rows, want = random.Random(3), [], []
    for path in "ab":
        pos = held = 0
        for _ in range(3000):
            size = rng.randrange(1, 40)
            rows.append((path, pos, size))
            pos, held = pos + size, held + size
            if held >= 100:
                want.append((path, held))
                held = 0
        want += [(path, held)] if held else []
    rng.shuffle(rows)
    sizes = delimited.split_sizes(spark.createDataFrame(rows, "path string, pos bigint, size bigint"), 100)
    assert [(r["path"], r["size"]) for r in sizes.orderBy("path", "part").collect()] == want
    assert "FlatMapGroups" not in sizes._jdf.queryExecution().executedPlan().toString()


def test_json_records(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"a": 1}\n\n  \n[1, 2]\n3\n{"b": null}\nnot json\n')
    got = records.json_records(spark, str(tmp_path / "f.json")).select(F.to_json("v").alias("v"), "error").collect()
    assert [(r["v"], r["error"]) for r in got] == [('{"a":1}', None), ("[1,2]", None), (None, "ParseError"), ('{"b":null}', None), (None, "ParseError")]
    df = spark.createDataFrame([(1, None)], "a int, b string")
    writers.write_json(df, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == '{"a":1,"b":null}'


def test_parquet(spark, tmp_path):
    df = spark.sql("select cast(1 as tinyint) a, cast(1.5 as float) b, X'00FF' c, date'2020-02-01' d, cast(18446744073709551615 as decimal(20,0)) e, 'x' f")
    df.write.parquet(str(tmp_path / "p"))
    out = records.parquet(spark, str(tmp_path / "p"))
    assert [t for _, t in out.dtypes] == ["bigint", "double", "string", "timestamp", "decimal(20,0)", "string"]
    r = out.first()
    assert r["c"] == "AP8=" and int(r["e"]) == 2**64 - 1
    assert spark.range(1).select(records.uuid_text(F.unhex(F.lit("00112233445566778899AABBCCDDEEFF")))).first()[0] == "00112233-4455-6677-8899-aabbccddeeff"
    with pytest.raises(ValueError):
        records.normalised(spark.sql("select array(1) x"))
    rows = records.in_order(spark.read.parquet(str(tmp_path / "p")))
    assert rows.orderBy("_file", "_row").limit(1).count() == 1


def test_arrow(spark):
    df = spark.range(3000).select("id", F.lit(None).cast("string").alias("none"))
    out = writers.arrow_result(df, [("n", "decimal(10,2)"), ("s", "string")])
    sizes = [b.num_rows for b in writers.arrow_batches(out)]
    assert sum(sizes) == 3000 and max(sizes) <= 1024
    for bad in ([("n", "int64")], [("n", "int32"), ("s", "string")]):
        with pytest.raises(ValueError):
            writers.arrow_result(df, bad)
    page = writers.listing_table(df.limit(3).withColumn("Name", F.lit(None).cast("string")), "m")
    assert page.column_names == ["id", "Name"] and page.schema.metadata == {b"NumberOfRecords": b"3", b"NextMarker": b"m"}
