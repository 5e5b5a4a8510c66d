import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lexwarden.schemas import RAW_NEMOTRON, _struct
from lexwarden.sources import config, files, jsonl, sinks
from lexwarden.streaming.ingest import canonical_stream, raw_stream, windowed_counts

LINES = ['{"id": "a", "prompt": "p"}', "", "[1, 2]", '{"id": 0, "prompt": NaN}', '{"id": "", "prompt": "q", "language": "zh-CN"}', '"text"', '{"id": 7, "prompt": true}']


@pytest.fixture
def folder(tmp_path):
    for language in ("en", "zh"):
        (tmp_path / language).mkdir()
        (tmp_path / language / "train.jsonl").write_text("\n".join(LINES) + "\n", encoding="utf-8")
    (tmp_path / "en" / "validation.jsonl").write_text(LINES[0], encoding="utf-8")
    return tmp_path


def test_jsonl(spark, folder):
    rows = jsonl.read_split(spark, str(folder), "train").orderBy("source_path", "source_line").collect()
    assert [(r.source_path.split("/")[-2], r.source_line, r.id, r.prompt) for r in rows if "/en/" in r.source_path] == [("en", 1, "a", "p"), ("en", 4, None, None), ("en", 5, None, "q"), ("en", 7, "7", "True")]
    assert jsonl.read_split(spark, str(folder), "valid").count() == 1
    with pytest.raises(FileNotFoundError):
        jsonl.read_split(spark, str(folder), "test")
    with pytest.raises(Exception, match="no object"):
        jsonl.read_jsonl(spark, str(folder), strict=True).collect()
    (folder / "en" / "bad.jsonl").write_text("{", encoding="utf-8")
    with pytest.raises(Exception, match="malformed JSON"):
        jsonl.read_jsonl(spark, str(folder), name_glob="bad.jsonl").collect()


def test_line_numbers_over_file_blocks(spark, tmp_path):
    text = "".join(json.dumps({"id": str(i), "prompt": "x" * (i % 50)}) + "\n" + "\n" * (i % 3 == 0) for i in range(3000))
    (tmp_path / "a.jsonl").write_text(text, encoding="utf-8")
    want = {str(i): n for n, line in enumerate(text.split("\n"), 1) if line for i in [json.loads(line)["id"]]}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        df = jsonl.read_jsonl(spark, str(tmp_path), RAW_NEMOTRON)
        assert df.rdd.getNumPartitions() > 3
        assert {r.id: r.source_line for r in df.collect()} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_rows_file(spark, tmp_path):
    schema = _struct("model string, score double")
    assert jsonl.read_rows(spark, str(tmp_path / "none.json"), schema).count() == 0
    (tmp_path / "a.json").write_text("{}")
    assert jsonl.read_rows(spark, str(tmp_path / "a.json"), schema).count() == 0
    (tmp_path / "b.json").write_text('[{"model": "m", "score": NaN}, {"model": "n", "score": 1}]')
    assert [tuple(r) for r in jsonl.read_rows(spark, str(tmp_path / "b.json"), schema).collect()] == [("m", None), ("n", 1.0)]


def test_csv(spark, tmp_path):
    (tmp_path / "en").mkdir()
    (tmp_path / "en" / "Theft.csv").write_bytes('﻿one, two\n"a ""q"", b",c\n\n"line\nbreak"\n  \nlonger,than,first\n'.encode())
    (tmp_path / "en" / "Commonsense.csv").write_text("no\n")
    got = files.read_csv_records(spark, str(tmp_path), ["en"]).orderBy("record_no").collect()
    assert [(r.file_name, r.record_no, r.prompt) for r in got] == [("Theft.csv", 1, "one, two"), ("Theft.csv", 2, 'a "q", b,c'), ("Theft.csv", 4, "line\nbreak"), ("Theft.csv", 6, "longer,than,first")]
    with pytest.raises(ValueError, match="unsupported language"):
        files.read_csv_records(spark, str(tmp_path), ["xx"])
    with pytest.raises(FileNotFoundError):
        files.read_csv_records(spark, str(tmp_path), ["es"])


def test_archives(spark, tmp_path):
    good, bad, link = tmp_path / "good.zip", tmp_path / "bad.zip", tmp_path / "link.zip"
    with zipfile.ZipFile(good, "w") as z:
        z.writestr("en/train.jsonl", "x")
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("../evil", "x")
    with zipfile.ZipFile(link, "w") as z:
        info = zipfile.ZipInfo("l")
        info.external_attr = 0o120777 << 16
        z.writestr(info, "t")
    problems = {r.archive.split("/")[-1]: r.problem for r in files.archive_totals(files.archive_members(spark, str(tmp_path / "*.zip"))).collect()}
    assert problems == {"good.zip": None, "bad.zip": "unsafe path", "link.zip": "symbolic link"}
    files.check_archives(files.archive_members(spark, str(good)))
    with pytest.raises(ValueError, match="unsafe path"):
        files.check_archives(files.archive_members(spark, str(bad)))
    members = files.archive_members(spark, str(good))
    assert {(r.name, r.n) for r in files.merged_members(members.unionByName(members), ["en/train.jsonl", "en/test.jsonl"]).collect()} == {("en/train.jsonl", 2), ("en/test.jsonl", 0)}
    assert files.match_archive(str(tmp_path), ["GOOD*"]) == str(good)
    assert files.match_archive(str(tmp_path), ["none*"]) is None
    with pytest.raises(ValueError, match="several"):
        files.match_archive(str(tmp_path), ["*.zip"])


def test_roots_headers_digests(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "m.txt").write_text("x")
    assert files.find_root(str(tmp_path), "b/m.txt") == str(tmp_path / "a")
    with pytest.raises(ValueError, match="one root"):
        files.find_root(str(tmp_path), "none.txt")
    head = json.dumps({}).encode()
    (tmp_path / "w1").write_bytes(len(head).to_bytes(8, "little") + head + b"1")
    (tmp_path / "w2").write_bytes(b"\xff" * 20)
    assert {r.path[-2:]: r.ok for r in files.weight_headers(spark, [str(tmp_path / n) for n in ("w1", "w2", "w3")]).collect()} == {"w1": True, "w2": False, "w3": False}
    import hashlib

    assert files.file_digests(spark, str(tmp_path / "w1")).first().sha256 == hashlib.sha256((tmp_path / "w1").read_bytes()).hexdigest()
    status = files.readiness(spark, [("x", str(tmp_path / "w1")), ("y", str(tmp_path / "none")), ("z", str(tmp_path / "a"))])
    assert {r.key: r.ready for r in status.collect()} == {"x": True, "y": False, "z": True}
    advice = spark.createDataFrame([("x", 1, "do x"), ("y", 2, "do y")], "key string, step int, advice string")
    assert [(r.advice, r.missing) for r in files.next_actions(status, advice).collect()] == [("do y", ["y"])]


def test_config(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"seahelm": {"vi": ["t"]}}')
    assert config.registered_tasks(str(path)) == {"t"} and config.registered_tasks(str(tmp_path / "none")) == set()
    path.write_text("[1]")
    with pytest.raises(ValueError, match="no mapping"):
        config.load_config(str(path))
    assert config.model_id("m", "hub/m", {"MODEL_PATH_M": "/x"}) == "/x" and config.model_id("m", "hub/m", {}) == "hub/m"
    assert config.models_frame(spark, [{"name": "a", "id": "1"}, {"name": "a", "id": "2"}]).collect()[0].id == "2"
    assert config.merged_settings({"a": 1, "b": 2}, {"b": 3}) == {"a": 1, "b": 3}


def test_merge_and_contract(spark, tmp_path):
    for name, member in (("a", "en/train.jsonl"), ("b", "en/test.jsonl"), ("c", "en/test.jsonl")):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr(member, '{"id": "1"}\n')
    part = {n: str(tmp_path / f"{n}.zip") for n in "abc"}
    out = str(tmp_path / "out.zip")
    assert files.merge_archives([part["a"], part["b"]], out, ["en/train.jsonl", "en/test.jsonl"]) == 2
    with pytest.raises(ValueError, match="repeated"):
        files.merge_archives([part["b"], part["c"]], str(tmp_path / "x.zip"))
    with pytest.raises(ValueError, match="missing"):
        files.merge_archives([part["a"]], str(tmp_path / "x.zip"), ["en/test.jsonl"])
    assert not list(tmp_path.glob("x.zip*"))
    (tmp_path / "r.jsonl").write_text('{"id": "1", "prompt": "p"}\n')
    assert jsonl.read_contract(spark, str(tmp_path / "r.jsonl"), RAW_NEMOTRON).first().prompt == "p"
    (tmp_path / "r.jsonl").write_text("{bad\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        jsonl.read_contract(spark, str(tmp_path / "r.jsonl"), RAW_NEMOTRON).collect()
    config.write_config({"a": [1]}, str(tmp_path / "c.yaml"))
    assert config.load_config(str(tmp_path / "c.yaml")) == {"a": [1]}
    status = files.readiness(spark, [("x", out), ("y", str(tmp_path / "none"))])
    with pytest.raises(ValueError, match="not ready: y"):
        files.check_ready(status)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("e1", "en", "P", "p", "safe", None)], "example_id string, language string, view string, prompt string, safety_label string, response string")
    sinks.write_benchmark(df, str(tmp_path / "b"))
    text = next((tmp_path / "b").glob("*.json")).read_text()
    assert json.loads(text)["response"] is None
    with pytest.raises(ValueError, match="missing fields"):
        sinks.write_benchmark(df.drop("view"), str(tmp_path / "c"))
    assert sinks.write_csv(df, str(tmp_path / "d.csv")) == 1
    assert (tmp_path / "d.csv").read_bytes().startswith(b"\xef\xbb\xbfexample_id,")
    sinks.write_json(df, str(tmp_path / "e.json"))
    assert json.loads((tmp_path / "e.json").read_text())[0]["example_id"] == "e1"
    facts = sinks.manifest(spark.createDataFrame([("examples", 1)], "key string, n long"), policy="incorrect")
    assert facts["examples"] == 1 and facts["policy"] == "incorrect"
    assert sinks.written_digest(df).first() == sinks.written_digest(df.repartition(3)).first()
    assert "backup" in sinks.move_to_backup(str(tmp_path / "e.json")) and sinks.move_to_backup(str(tmp_path / "none")) is None


def test_stream(spark, tmp_path, sf_dir):
    source = spark.read.parquet(f"{sf_dir}/nemotron_raw.parquet")
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = canonical_stream(raw_stream(spark, str(tmp_path / "in"), source.schema, 1), "400 days")
    query = stream.writeStream.format("memory").queryName("views").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("views")
    keys = ["source_split", "source_id", "view", "language"]
    from lexwarden.operators.canonical import canonical_views

    assert got.count() == got.select(*keys).distinct().count() == canonical_views(source).select(*keys).distinct().count()
    counts = windowed_counts(got)
    assert counts.agg(F.sum("n")).first()[0] == got.count()


def test_training_config_and_evaluated_model():
    from lexwarden.sources import config as G

    settings = {"training": {"common": {"epochs": 1, "max_length": 64, "smoke_max_steps": 2}, "lora": {"lora_r": 8, "lora_alpha": 16, "lora_dropout": 0.1}, "full": {"rate": 0.5}}, "data": {"output_dir": "d"}}
    model = {"name": "m", "id": "x/m", "family": "f", "target_modules": ["q"]}
    lora, full = (G.training_config(settings, model, k, "out", f"m-{k}", {}) for k in ("lora", "full"))
    assert lora["model"]["lora_r"] == 8 and lora["model"]["target_modules"] == ["q"] and lora["training"] == {"epochs": 1} and lora["data"]["max_length"] == 64
    assert "lora_r" not in full["model"] and full["training"] == {"epochs": 1, "rate": 0.5} and full["data"]["validation"] == "d/valid.jsonl"
    assert G.training_config(settings, model, "full", "out", "r", {"MODEL_PATH_M": "/m"})["model"]["id"] == "/m"
    assert G.evaluated_model("x/m", "runs", "m", "lora", "t", False) == ("x/m", None, "runs/m/base")
    assert G.evaluated_model("x/m", "runs", "m", "lora", "t", True) == ("x/m", "t/final", "t") and G.evaluated_model("x/m", "runs", "m", "full", "t", True) == ("t/final", None, "t")


def test_extraction(tmp_path):
    import zipfile

    from lexwarden.sources import files as S

    good, bad, out = tmp_path / "a.zip", tmp_path / "b.zip", tmp_path / "out"
    with zipfile.ZipFile(good, "w") as z:
        z.writestr("x/y.txt", "1")
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("../y.txt", "1")
    assert S.extract_archive(str(good), str(out)) == 1 and (out / "x" / "y.txt").read_text() == "1"
    with pytest.raises(ValueError, match="unsafe"):
        S.extract_archive(str(bad), str(out))
    assert (out / "x" / "y.txt").exists()
    S.extract_archive(str(good), str(out))
    assert any(p.name.startswith("out.backup-") for p in tmp_path.iterdir()) and not any(".draft-" in p.name for p in tmp_path.iterdir())


def test_archive_choice(spark):
    from lexwarden.sources import files as S

    specs = spark.createDataFrame([("a", "x"), ("b", "y")], "key string, destination string")
    assert [r.key for r in S.chosen_archives(specs, ["b"]).collect()] == ["b"] and S.chosen_archives(specs).count() == 2
    with pytest.raises(ValueError, match="unknown"):
        S.chosen_archives(specs, ["c"])
