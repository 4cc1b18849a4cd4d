import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from vectrine import cli, index, mcp
from vectrine.functions import text as tx
from vectrine.operators import chunk, messages, passages, rag
from vectrine.sources import chat, files, history, mail
from vectrine.streaming import ingest

CODE = "import os\n\n\n@cached\ndef one():\n    return 1\n\n\nclass Two:\n    def three(self):\n        return 3\n"


def test_code_chunks():
    parts = chunk.split_code(CODE, "python", 40, 0)
    assert [p.split("\n")[0] for p in parts] == ["import os", "@cached", "class Two:"]
    assert chunk.split_code("def broken(:\n  x", "python")
    assert chunk.split_code("  ", "python") == []
    assert "".join(chunk.split_code("a\nb\nc\n", "java", 4, 0)).replace("\n", "") == "abc"


def test_sentence_chunks_cover_and_fit():
    text = " ".join(f"Word{i} is here." for i in range(300))
    parts = chunk.pack_sentences(text, 50, 10)
    assert all(len(p.split()) <= 50 for p in parts)
    assert {w for p in parts for w in p.split()} == set(text.split())
    assert chunk.pack_sentences("", 10, 2) == []
    assert chunk.checked(0, 300) == (256, 255) and chunk.checked(10, 20, halve=True) == (10, 5)


def test_router(spark):
    rows = spark.createDataFrame(
        [("a.py", CODE), ("b.txt", "Some text. More."), ("c.cs", "int x;"), (None, "no path"), ("d.py", None)],
        "file_path string, text string"
    )
    found = chunk.chunk_documents(rows).collect()
    assert {(r["file_path"], r["language"]) for r in found} == {("a.py", "python"), ("b.txt", None), ("c.cs", "csharp"), (None, None)}


@pytest.mark.parametrize("overlap", [0, 1, 2])
@pytest.mark.parametrize("window", [-1, 30])
def test_grouping_against_a_loop(spark, overlap, window):
    rows = [(c, i, 60 * ((i * 37 + c) % 11) * i, "x" * (i * 7 % 23)) for c in range(3) for i in range(25)]
    got = {
        (r["conv"], r["group_no"], r["pos"]) for r in messages.group_messages(
            spark.createDataFrame(rows, "conv long, pos long, t long, text string"), 40, window, overlap
        ).collect()
    }
    want = set()
    for c in range(3):
        number, group, last = 0, [], None
        for _, i, t, text in (r for r in rows if r[0] == c):
            if not text.strip():
                continue
            for rule in ("gap", "length"):
                full = window != -1 and last is not None and t > 0 and (t - last) / 60 > window if rule == "gap" else sum(
                    n for _, n in group
                ) + len(text) > 40
                if full and group:
                    group = group[-overlap:] if 0 < overlap < len(group) else []
                    number += 1
                    want |= {(c, number, p) for p, _ in group}
            group.append((i, len(text)))
            last = t
            want.add((c, number, i))
    assert got == want


def test_messages(spark):
    rows = spark.createDataFrame(
        [("wxid_1: hello",), ("<img cdnurl=x>",), ("a recalled a message",), ("Bob: hi",), ("",), (None,)], "c string"
    )
    assert [(r[0], r[1]) for r in rows.select(messages.readable(F.col("c")), messages.is_text_message(F.col("c"))).collect()] == [
        ("hello", True), ("", False), ("", False), ("hi", True), ("", False), ("", False)
    ]
    v = spark.createDataFrame([('{"title":"t","text":"x"}',), ('"Bob: hi"',)], "j string").select(
        messages.readable_fields(F.parse_json("j"))
    ).collect()
    assert [r[0] for r in v] == ["t | x", "hi"]


def test_passages(spark, tmp_path):
    docs = spark.createDataFrame([("a", 1), (" ", 2), ("b", 3)], "text string, n int").coalesce(1)
    held = passages.from_documents(docs)
    assert [(r["id"], r["text"]) for r in held.orderBy("pos").collect()] == [("0", "a"), ("1", "b")]
    for i, rows in enumerate(([("x", "one")], [("x", "two"), ("y", "three")])):
        passages.write_json_lines(spark.createDataFrame(rows, "id string, text string"), str(tmp_path / str(i)))
    shards = passages.read_shards(spark, [str(tmp_path / "0"), str(tmp_path / "1")])
    assert {(r["id"], r["text"]) for r in passages.first_shard_wins(shards.select("id", "shard", "text")).collect()} == {
        ("x", "one"), ("y", "three")
    }
    assert passages.get(held, "1")["text"] == "b"
    with pytest.raises(KeyError):
        passages.get(held, "7")
    with pytest.raises(ValueError):
        passages.aligned(held, spark.createDataFrame([("0", [1.0])], "id string, embedding array<float>"))


def test_index_round_trip(spark, tmp_path):
    builder = index.Builder(spark)
    for i in range(60):
        builder.add_text(f"document {i} about topic {i % 5}", {"topic": i % 5, "id": f"d{i}"})
    builder.add_text("   ")
    path = str(tmp_path / "one")
    assert builder.build(path).rows == 60
    found = index.Searcher(spark, path).search(["document 7 about topic 2"], 5)
    assert found.first()["id"] == "d7"
    assert all(
        json.loads(str(r["metadata"]))["topic"] == 2 for r in index.Searcher(spark, path).search(
            "topic 2", 10, filters={"topic": {"==": 2}}
        ).collect()
    )
    assert index.Chat(spark, path, {"type": "simulated"}).ask("what?") == rag.SIMULATED
    with pytest.raises(FileExistsError):
        index.Builder(spark).add_text("x").build(path)
    with pytest.raises(FileNotFoundError):
        index.Searcher(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        index.Builder(spark, graph_degree=3)
    with pytest.raises(ValueError):
        index.Builder(spark).add_text("a", {"id": 1}).add_text("b", {"id": 1}).build(str(tmp_path / "two"))
    with pytest.raises(RuntimeError):
        index.Searcher(spark, path).search("x", recompute=False)
    assert [i["name"] for i in index.find("one", [str(tmp_path)])] == ["one"]
    with pytest.raises(PermissionError):
        index.remove("one", [str(tmp_path)])
    index.remove("one", [str(tmp_path)], force=True)
    assert index.find("one", [str(tmp_path)]) == []


def test_index_from_embeddings(spark, sf, tmp_path):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    m = index.Builder(spark, "flat").build_from_embeddings(str(tmp_path / "e"), vectors)
    assert (m.rows, m.dimensions, m.is_pruned) == (vectors.count(), 64, False)


def test_files(spark, tmp_path):
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "sub").mkdir()
    for name, body in {
        "a.txt": "one", "b.py": "x = 1", ".hidden/c.txt": "no", "sub/d.md": "two", "e.bin": "no", "skip.log": "no", ".gitignore": "*.log\n"
    }.items():
        (tmp_path / name).write_text(body)
    with pytest.warns(UserWarning):
        rows = files.read(spark, [str(tmp_path), str(tmp_path / "gone")]).collect()
    assert sorted(r["file_name"] for r in rows) == ["a.txt", "b.py", "d.md"]
    assert [r["text"] for r in files.read(spark, [str(tmp_path)], [".md"]).collect()] == ["two"]
    assert [r["file_name"] for r in files.read_code(spark, str(tmp_path)).collect()] == ["b.py"]
    assert files.parse_extensions(".txt, pdf") == [".txt", ".pdf"]
    assert files.is_ignored("a/build/x.o", ["build/"]) and not files.is_ignored("keep.log", ["*.log", "!keep.log"])


def test_history(spark, tmp_path):
    with sqlite3.connect(tmp_path / "History") as db:
        db.execute(
            "CREATE TABLE urls (last_visit_time INTEGER, url TEXT, title TEXT, visit_count INTEGER, typed_count INTEGER, hidden INTEGER)"
        )
        db.executemany(
            "INSERT INTO urls VALUES (?, ?, ?, 1, 0, 0)",
            [(11_644_473_600_000_000 + i * 1_000_000, f"http://x/{i}", f"t{i}") for i in range(10)]
        )
    found = history.read(spark, str(tmp_path / "History"), 3).collect()
    assert [r["title"] for r in found] == ["t9", "t8", "t7"]
    assert "1970-01-01 00:00:09" in found[0]["text"]


def test_mail(spark, tmp_path):
    message = b"From: a@x\nTo: b@x\nSubject: Hi\nContent-Type: text/plain\n\nBody text\n"
    (tmp_path / "1.emlx").write_bytes(b"99\n" + message)
    (tmp_path / "2.emlx").write_bytes(b"99\nFrom: a@x\n\n  \n")
    rows = mail.read(spark, str(tmp_path)).collect()
    assert [(r["subject"], r["body"].strip()) for r in rows] == [("Hi", "Body text")]
    (tmp_path / "box").mkdir()
    (tmp_path / "box/inbox").write_bytes(b"From a Mon\n" + message + b"\nFrom b Tue\n" + message)
    assert mail.documents(mail.read(spark, str(tmp_path / "box"), "mbox")).count() == 2
    assert tx.html_text("<p>a<script>x</script> <b>b</b></p>") == "a b"


def test_chat(spark, tmp_path):
    held = [
        {"content": "Bob: hi", "createTime": 10, "isSentFromSelf": False},
        {"content": {"title": "t"}, "createTime": 20, "isSentFromSelf": True},
        {"content": "", "message": "plain", "createTime": 0}
    ]
    (tmp_path / "Ann.json").write_text(json.dumps(held))
    rows = chat.read(spark, str(tmp_path))
    assert [(r["contact"], r["text"]) for r in rows.orderBy("pos").collect()] == [("Ann", "hi"), ("Ann", "t"), ("Ann", "plain")]
    assert chat.documents(rows).first()[
        "text"
    ] == "(1970-01-01 00:00:10) [Contact]: hi\n(1970-01-01 00:00:20) [Me]: t\n(Unknown) [Contact]: plain"
    chat.export_text(rows, str(tmp_path / "out"))
    assert chat.exports(tmp_path) == [tmp_path]


def test_tool_server_and_options():
    assert mcp.answer({"id": 1, "method": "initialize"})["result"]["serverInfo"]["name"] == "vectrine"
    assert mcp.answer({"method": "notifications/initialized"}) is None
    assert mcp.answer({"id": 2, "method": "x"})["error"]["code"] == -32601
    assert mcp.answer({"id": 3, "method": "tools/call", "params": {"name": "x"}})["result"]["isError"]
    assert rag.options_for("openai", "o3-mini", {"thinking_budget": "low"})["max_completion_tokens"] == 1000
    with pytest.raises(ValueError):
        rag.llm({"type": "other"})
    assert tx.suggest("llama", ["qwen:7b", "llama3:8b", "Llama"])[0] == "Llama"
    assert cli.parser().parse_args(["search", "i", "t"]).top_k == 5


def test_streams(spark, sf, tmp_path):
    docs = spark.readStream.schema("doc_id long, text string").parquet(
        f"{sf}/documents.parquet".replace("documents.parquet", "docum*.parquet")
    )
    query = ingest.append_passages(docs, str(tmp_path / "out"), str(tmp_path / "c"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).select("doc_id").distinct().count() == spark.read.parquet(
        f"{sf}/documents.parquet"
    ).count()
    talks = spark.readStream.schema("conv_id long, turn long, role string, text string").parquet(f"{sf}/convers*.parquet").select(
        F.col("conv_id").alias("conv"), F.col("turn").alias("pos"), "text"
    )
    run = ingest.length_groups(talks, 400).writeStream.format("memory").queryName("lengths").trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "d")
    ).start()
    run.awaitTermination(120)
    batch = spark.read.parquet(f"{sf}/conversations.parquet").select(
        F.col("conv_id").alias("conv"), F.col("turn").alias("pos"), F.lit(0).cast("long").alias("t"), "text"
    )
    want = {(r["conv"], r["pos"], r["group_no"]) for r in messages.group_messages(batch, 400, -1).collect()}
    assert {tuple(r) for r in spark.table("lengths").collect()} == want


def test_sessions_of_a_hot_key(spark):
    """One key with a third of all events, one that is null; more ranges than one for each."""
    import random

    draw = random.Random(5)
    rows = [(i, draw.choice(["hot", "hot", "a", "b", None]), draw.randrange(200_000)) for i in range(900)]
    events = spark.createDataFrame(rows, "i long, k string, t long").select("i", "k", F.timestamp_seconds("t").alias("ts"))
    got = {r["i"]: r["session_no"] for r in messages.time_sessions(events, "k", "ts", 5, 7).collect()}
    for key in ("hot", "a", "b", None):
        last, number, want = None, 0, {}
        for t, i in sorted((t, i) for i, k, t in rows if k == key):
            number += last is not None and t - last > 300
            want[i], last = number, t
        assert {i: got[i] for i in want} == want
