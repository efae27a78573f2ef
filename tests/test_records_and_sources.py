"""Record mapping, readers and writers."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.functions.variant import text_of
from tallyforge.operators.evaluate import join_predictions
from tallyforge.operators.records import byte_tokenize, conversation_lines, conversation_to_text, map_prediction, map_record_text
from tallyforge.operators.suite import Benchmark
from tallyforge.sources import (
    file_manifest,
    ingest_jsonl_records,
    numbered_lines,
    read_eval_samples,
    read_predictions,
    read_records,
    write_transcripts,
)


def texts(df):
    return [r.text for r in map_record_text(df).orderBy("i").collect()]


def test_record_text_forms(spark):
    records = [
        {"text": "plain", "prompt": "x", "response": "y"},
        {"prompt": "p", "response": 3},
        {"instruction": "do", "output": "done"},
        {"instruction": "do", "input": "with", "output": "done"},
        {"messages": [{"role": "system", "content": "s"}, {"content": "hi"}, "skip", {"role": "assistant"}]},
        {"trajectory": {"b": [1, 2], "a": "x"}, "reward": 1},
        {"z": 1, "a": None},
        {"text": None},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "i int, j string")
    assert texts(df.select("i", F.parse_json("j").alias("record"))) == [
        "plain",
        "p\n3",
        "do\n\ndone",
        "do\nwith\ndone",
        "system: s\nuser: hi\nassistant: ",
        '{"a": "x", "b": [1, 2]}',
        '{"a": null, "z": 1}',
        "None",
    ]


def test_ingest_lines(spark):
    lines = ['{"text": "a"}', "  ", '"quoted"', "not json {", "12.0", "true", "null", '[1, "x"]', '  {"text": "b"}\t']
    df = spark.createDataFrame(list(enumerate(lines)), "i int, value string")
    out = ingest_jsonl_records(df)
    assert [r.kind for r in out.orderBy("i").collect()] == ["object"] + ["scalar", "invalid"] + ["scalar"] * 4 + ["object"]
    assert texts(out) == ["a", "quoted", "not json {", "12.0", "True", "None", '[1, "x"]', "b"]


def test_read_records(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"text": "a"}\n\nb\n')
    assert sorted(r.text for r in map_record_text(read_records(spark, str(tmp_path))).collect()) == ["a", "b"]


def encode(text, length):
    tokens = [1, *(b + 3 for b in text.encode()), 2]
    return (tokens + [0] * (length - len(tokens)))[:length]


def test_byte_tokenize(spark):
    words = ["", "a", "é€", "abcdef", "abcdefg", "abcdefghij"]
    df = spark.createDataFrame(list(enumerate(words)), "i int, text string")
    rows = byte_tokenize(df, seq_len=8).orderBy("i").collect()
    assert [r.input_ids for r in rows] == [encode(w, 8) for w in words]
    assert [r.labels for r in rows] == [[-100 if t == 0 else t for t in encode(w, 8)] for w in words]


def test_conversations_are_one_row_each_at_any_length(spark):
    turns = [("c", i, "user" if i % 2 == 0 else None, f"t{i}") for i in range(5000)] + [("d", 0, "assistant", "x")]
    df = spark.createDataFrame(turns, "conv_id string, turn long, role string, text string")
    rows = conversation_to_text(df).orderBy("conv_id").collect()
    assert [(r.conv_id, r.turns) for r in rows] == [("c", 5000), ("d", 1)]
    assert rows[0].text == "\n".join(f"user: t{i}" for i in range(5000))
    lines = conversation_lines(df).filter("conv_id = 'd'").collect()
    assert [(r.turn, r.line) for r in lines] == [(0, "assistant: x")]


def test_map_prediction(spark):
    rows = [
        ('{"model_output": 5, "output": "x"}', '{"answer": "a", "text": "t"}'),
        ('{"prediction": null}', "plain"),
        ("{}", '{"other": 1}'),
        ('{"response": "r"}', "[1]"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, j string, output string")
    out = map_prediction(df.withColumn("payload", F.parse_json("j"))).orderBy("i").collect()
    assert [r.sample_prediction for r in out] == ["5", "None", "", "r"]
    assert [r.model_prediction for r in out] == ["t", "plain", '{"other": 1}', "[1]"]


def test_lines_are_numbered_across_splits_and_parts(spark, tmp_path):
    part = tmp_path / "many.jsonl"
    part.mkdir()
    (part / "part-0.txt").write_text("".join(f"line {i}\n" for i in range(700)))
    (part / "part-1.txt").write_text("".join(f"line {i}\n" for i in range(700, 1000)))
    (tmp_path / "one.jsonl").write_text("line 0\nline 1\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = numbered_lines(spark, str(tmp_path)).collect()
        assert spark.read.text(str(part)).rdd.getNumPartitions() > 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(rows) == 1002
    assert all(r.value == f"line {r.line_index}" for r in rows)
    assert {r.stem for r in rows} == {"many", "one"}


def predictions(spark, path):
    df = read_predictions(spark, str(path))
    return {r.id: r.p for r in df.select("id", F.expr(text_of("prediction")).alias("p")).collect()}


def test_prediction_files(spark, tmp_path):
    lines = [{"id": "a", "prediction": "1"}, {"sample_id": 2, "response": "two"}, {"id": "a", "prediction": "last"}, {"id": "c"}]
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\n")
    expected = {"a": "last", "2": "two", "c": '{"id": "c"}'}
    assert predictions(spark, tmp_path / "p.jsonl") == expected
    (tmp_path / "list.json").write_text(json.dumps(lines))
    assert predictions(spark, tmp_path / "list.json") == expected
    folder = tmp_path / "several.json"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps([{"id": "x", "prediction": "early"}] * 5 + [{"id": "y", "prediction": "only"}]))
    (folder / "b.json").write_text(json.dumps({"x": "late"}))
    assert predictions(spark, folder) == {"x": "late", "y": "only"}
    (tmp_path / "held.json").write_text(json.dumps({"predictions": lines}))
    assert predictions(spark, tmp_path / "held.json") == expected
    (tmp_path / "flat.json").write_text(json.dumps({"a": "x", "b": [1], "c": None}))
    assert predictions(spark, tmp_path / "flat.json") == {"a": "x", "b": "[1]", "c": "None"}


def test_samples_by_file_name_dimension_scan_and_generation(spark, tmp_path):
    def write(name, rows):
        (tmp_path / name).write_text("\n".join(json.dumps(r) for r in rows) + "\n")

    write("my_bench.jsonl", [{"id": "s1", "question": "q", "gold": 4}, "bare text"])
    write("dim.jsonl", [{"sample_id": "d1", "dataset": "D", "benchmark": "elsewhere", "prompt": "p"}])
    write("other.jsonl", [{"prompt": "x", "dataset": "wanted"}, {"prompt": "y", "benchmark": "named"}])
    suite = [
        Benchmark("My Bench", "none"),
        Benchmark("first", "dim"),
        Benchmark("second", "dim"),
        Benchmark("third", "z", ("wanted",)),
        Benchmark("named", "z"),
        Benchmark("nothing", "z", ("ds",)),
    ]
    samples = read_eval_samples(spark, str(tmp_path), suite)
    rows = {(r.benchmark, r.id): r for r in samples.select("*", F.expr(text_of("reference")).alias("ref")).collect()}
    assert set(rows) == {
        ("My Bench", "s1"),
        ("My Bench", "My Bench-000001"),
        ("first", "d1"),
        ("second", "d1"),
        ("third", "other-000000"),
        ("named", "other-000001"),
        ("nothing", "nothing-generated-0"),
    }
    assert rows["My Bench", "s1"].ref == "4"
    assert rows["My Bench", "My Bench-000001"].prompt == "bare text"
    assert rows["nothing", "nothing-generated-0"].dataset == "ds"


@pytest.mark.parametrize("name", ["Core One", "50% more", "a+b", "Übung 1", "c%20d", "plain"])
def test_samples_of_files_with_odd_names_beside_other_files(spark, tmp_path, name):
    (tmp_path / f"{name}.jsonl").write_text('{"id": "x", "prompt": "p", "answer": "a"}\n\n{"prompt": "q"}\n')
    (tmp_path / "README.md").write_text("# no JSON\n")
    (tmp_path / "notes.json").write_text("{broken")
    samples = read_eval_samples(spark, str(tmp_path), [Benchmark(name, "dim")])
    assert sorted(r.id for r in samples.collect()) == sorted(["x", f"{name}-000002"])


def test_transcripts(spark, tmp_path):
    df = spark.createDataFrame(
        [("1", "My Bench", "d", "p", None), ("2", "My Bench", "d", "p", '"r"'), ("3", "b", "d", "p", "[1]")],
        "id string, benchmark string, dataset string, prompt string, r string",
    ).select("*", F.parse_json("r").alias("reference"), F.parse_json(F.lit('{"prediction": "x"}')).alias("payload"))
    counts = write_transcripts(join_predictions(df), str(tmp_path / "out"))
    assert {r.benchmark: r.samples for r in counts.collect()} == {"My Bench": 2, "b": 1}
    lines = [json.loads(x) for f in (tmp_path / "out").glob("file=my_bench.jsonl/*.txt") for x in f.read_text().splitlines()]
    assert {line["id"]: line["reference"] for line in lines} == {"1": None, "2": "r"}
    assert set(lines[0]) == {"id", "benchmark", "dataset", "prompt", "reference", "prediction"}


def test_file_manifest(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "b.bin").write_bytes(b"bb")
    (tmp_path / "sub" / "a.bin").write_bytes(b"a")
    rows = {r.file: r for r in file_manifest(spark, str(tmp_path)).collect()}
    assert set(rows) == {"b.bin", "sub/a.bin"}
    assert rows["b.bin"].sha256 == hashlib.sha256(b"bb").hexdigest() and rows["b.bin"].bytes == 2
    assert rows["b.bin"].set_id == hashlib.sha256(b"b.bin\nsub/a.bin").hexdigest()[:16]


@pytest.mark.parametrize("most", [None, "1000"])
def test_files_too_long_for_a_row_are_in_the_manifest(spark, tmp_path, most):
    (tmp_path / "part 1%20").mkdir()
    content = {"part 1%20/long one.bin": random.Random(1).randbytes(3_000_001), "longer.bin": b"x" * 5000, "short.bin": b"s" * 1000}
    for name, data in content.items():
        (tmp_path / name).write_bytes(data)
    if most:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", most)
    try:
        rows = file_manifest(spark, str(tmp_path)).collect() if most else file_manifest(spark, str(tmp_path), whole_bytes=1000).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert sorted((r.file, r.bytes, r.sha256) for r in rows) == sorted((n, len(d), hashlib.sha256(d).hexdigest()) for n, d in content.items())
    assert {r.set_id for r in rows} == {hashlib.sha256("\n".join(sorted(content)).encode()).hexdigest()[:16]}
