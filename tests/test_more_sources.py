"""Readers, providers, templates and checks that no registered query covers."""

import argparse
import json
import sqlite3
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest

from vectrine import apps, index
from vectrine.functions import text as tx
from vectrine.operators import chunk, embed, evaluate
from vectrine.schema import Manifest, Store
from vectrine.sources import chat, evaluation, files, mail, vectors

JAVA = """package a.b;

import java.util.List;

/** A class with a brace { in its comment. */
public class One {
    private String s = "}{";

    int first() { return 1; }

    int second(int x) {
        if (x > 0) { return '{'; }
        return 2; // }
    }
}

interface Two { void third(); }
"""
TYPES = """import { a } from "b";

export const one = (x: number) => {
  return `${x} }`;
};

export class Two {
  three(): void { console.log("}"); }
}
"""


@pytest.mark.parametrize(
    "source, wanted", [(JAVA, ["package", "import", "class One", "interface Two"]), (TYPES, ["import", "const one", "class Two"])]
)
def test_declarations_of_brace_languages(source, wanted):
    units = chunk.brace_units(source)
    assert "".join(units) == source
    whole = [u for u in units if u.strip()]
    assert len(whole) == len(wanted) and all(w in u for w, u in zip(wanted, whole))


def test_large_declarations_are_cut_within():
    parts = chunk.split_code(JAVA, "java", 110, 0)
    assert any("int first()" in p and "int second" not in p for p in parts)
    assert "".join("".join(parts).split()) == "".join(JAVA.split())
    assert chunk.split_code("no braces at all " * 20, "java", 50, 0) and chunk.split_code("  ", "java") == []


def test_sentences_against_a_plain_packer():
    def plain(text, size, overlap):
        out, now = [], []
        for sentence in chunk._SENTENCE.split(text):
            words = sentence.split()
            for part in (words[i : i + size] for i in range(0, len(words), size)):
                if now and sum(map(len, now)) + len(part) > size:
                    out.append(" ".join(sum(now, [])))
                    while now and (sum(map(len, now)) > overlap or sum(map(len, now)) + len(part) > size):
                        now = now[1:]
                now = [*now, part]
        return [*out, " ".join(sum(now, []))] if now else out

    draw = np.random.default_rng(7)
    for _ in range(200):
        text = " ".join(
            "w" + "." * int(draw.random() < 0.2) + "\n\n" * int(draw.random() < 0.05) for _ in range(int(draw.integers(0, 120)))
        )
        assert chunk.pack_sentences(text, 20, 8) == plain(text, 20, 8)


def test_windows_keep_columns_with_any_name(spark):
    rows = spark.createDataFrame(
        [(1, "a b c d e", "x", 9), (2, None, "y", 9), (3, " \t", "z", 9)], "doc_id long, text string, _w string, chunk_no long"
    )
    out = chunk.word_windows(rows, 3, 1)
    assert out.columns == ["doc_id", "_w", "chunk_no", "chunk"]
    assert [tuple(r) for r in out.orderBy("chunk_no").collect()] == [(1, "x", 0, "a b c"), (1, "x", 1, "c d e")]


def test_tokens_in_place_of_words():
    pieces = lambda t: [t[i : i + 2] for i in range(0, len(t), 2)]
    assert chunk.use_tokens(pieces, "abcdefgh", 2, 1) == ["abcd", "cdef", "efgh"]


def test_pdf_readers_are_tried_in_turn(monkeypatch):
    said = []

    def broken(content):
        said.append("broken")
        raise OSError

    monkeypatch.setattr(files, "PDF_READERS", [broken, lambda c: "  ", lambda c: "text of " + c.decode()])
    assert files.pdf_text(b"it") == "text of it" and said == ["broken"]
    monkeypatch.setattr(files, "PDF_READERS", [broken])
    assert files.pdf_text(b"it") is None


def test_only_wanted_files_are_read(spark, tmp_path):
    for name, text in (
        ("a.py", "x = 1"),
        ("b.txt", "words"),
        ("node_modules/c.py", "no"),
        (".git/d.py", "no"),
        ("big.py", "#" * 50),
        ("odd [1]*.py", "y = 2")
    ):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    found = files.read_code(spark, str(tmp_path), max_bytes=40).collect()
    assert {r["file_name"]: r["text"] for r in found} == {"a.py": "x = 1", "odd [1]*.py": "y = 2"}
    plan = files.read(spark, [str(tmp_path)], [".py"])._jdf.queryExecution().optimizedPlan().toString()
    assert "node_modules" not in plan
    assert [r["extension"] for r in files.extensions_of(files.read(spark, [str(tmp_path)])).collect()] == [".py", ".txt"]


def test_archives_of_vectors(spark, tmp_path):
    (tmp_path / "a.npz").write_bytes(vectors.packed(np.array([3, 5]), np.array([[1, 2], [3, 4]], np.float32)))
    assert sorted((r["id"], list(r["embedding"])) for r in vectors.read(spark, str(tmp_path)).collect()) == [
        ("3", [1.0, 2.0]), ("5", [3.0, 4.0])
    ]
    with pytest.raises(ValueError):
        vectors.unpacked(vectors.packed(np.array([1]), np.zeros((2, 2))))


def test_golden_of_one_document(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"indices": [[4, 9, 2, 7], [1], []]}))
    assert sorted(map(tuple, evaluation.golden(spark, str(tmp_path), 3).collect())) == [(0, 1, 4), (0, 2, 9), (0, 3, 2), (1, 1, 1)]


def test_chats_to_sqlite_and_cards(spark, tmp_path):
    rows = spark.createDataFrame(
        [("a", 0, 5, True, "hi"), ("a", 1, 6, False, "ho"), ("b", 0, 7, True, "é")],
        "contact string, pos long, t long, own boolean, text string"
    )
    assert chat.export_sqlite(rows, str(tmp_path / "c.db"), batch=2) == 3
    with sqlite3.connect(tmp_path / "c.db") as db:
        assert db.execute("SELECT contact, pos, text FROM messages ORDER BY contact, pos").fetchall() == [
            ("a", 0, "hi"), ("a", 1, "ho"), ("b", 0, "é")
        ]
    inner = "<msg><title>deep</title></msg>".replace("<", "&lt;").replace(">", "&gt;")
    assert chat.unwrapped(f"<msg><title>top</title><refermsg><content>{inner}</content></refermsg></msg>") == "top | deep"
    assert chat.unwrapped("not xml") == "not xml"
    held = [{"n": i} for i in range(7)]
    assert list(chat.pulled(lambda contact, at, n: held[at : at + n], "a", 3)) == held


def test_mail_limits_have_an_order(spark, tmp_path):
    for i in range(4):
        (tmp_path / f"{i}.emlx").write_bytes(f"9\nSubject: s{i}\n\nbody {i}".encode())
    assert [r["subject"] for r in mail.read(spark, str(tmp_path), max_count=2).collect()] == ["s0", "s1"]


class _Service(BaseHTTPRequestHandler):
    asked: list = []

    def _say(self, held, status=200):
        self.send_response(status)
        self.end_headers()
        self.wfile.write(json.dumps(held).encode())

    def do_GET(self):
        self._say({"models": [{"name": "small:latest"}]})

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        _Service.asked.append(body)
        self._say({"embedding": [3.0, 4.0]} if "fails" not in body["prompt"] else {}, 200)

    def log_message(self, *_):
        pass


def test_ollama_service():
    server = HTTPServer(("127.0.0.1", 0), _Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    host = f"http://127.0.0.1:{server.server_port}"
    long = "word " * 5000
    out = embed._ollama([long, "fails"], "small", host)
    assert np.allclose(out, [[0.6, 0.8], [0, 0]])
    # whole texts are sent, to the model that the name stands for
    assert _Service.asked[0] == {"model": "small:latest", "prompt": long}
    with pytest.raises(ValueError):
        embed._ollama(["a"], "other", host)
    server.shutdown()


def test_remote_providers(monkeypatch):
    """Batches of the remote providers, by stand-ins for their packages."""
    import sys
    import types

    sizes = []

    class OpenAI:
        def __init__(self):
            self.embeddings = types.SimpleNamespace(
                create=lambda model, input: (
                    sizes.append(len(input)), types.SimpleNamespace(data=[types.SimpleNamespace(embedding=[1.0]) for _ in input])
                )[1]
            )

    monkeypatch.setitem(sys.modules, "openai", types.SimpleNamespace(OpenAI=OpenAI))
    assert len(embed.compute(["short"] * 900, "text-embedding-3-small", "openai")) == 900 and sizes == [800, 100]
    sizes.clear()
    embed.compute(["long " * 100] * 600, "text-embedding-3-small", "openai")
    assert sizes == [500, 100]

    kinds = []

    class Client:
        def __init__(self):
            self.models = types.SimpleNamespace(
                embed_content=lambda model, contents, config: (
                    kinds.append((len(contents), config["task_type"])),
                    types.SimpleNamespace(embeddings=[types.SimpleNamespace(values=[2.0]) for _ in contents])
                )[1]
            )

    genai = types.SimpleNamespace(Client=Client)
    monkeypatch.setitem(sys.modules, "google", types.SimpleNamespace(genai=genai))
    monkeypatch.setitem(sys.modules, "google.genai", genai)
    assert len(embed.compute(["a"] * 150, "m", "gemini")) == 150 and kinds == [(100, "RETRIEVAL_DOCUMENT"), (50, "RETRIEVAL_DOCUMENT")]


def test_token_pooling():
    tokenise = lambda texts, n: (np.array([[len(t), 1, 7] for t in texts]), np.array([[1, 1, 0]] * len(texts)))
    out = embed.by_tokens(["ab", "abcd"], tokenise, lambda ids, mask: ids[:, :, None].astype(float), batch_size=1)
    assert np.allclose(out, [[1.5], [2.5]])
    assert embed.device() in embed.DEVICE_BATCH


def test_models_are_checked():
    known = ["small:latest", "Large"]
    assert tx.checked_model("large", known) == "Large" and tx.checked_model("small", known) == "small:latest"
    with pytest.raises(ValueError, match="small"):
        tx.checked_model("smal", known)


def test_places_of_passages(tmp_path, monkeypatch):
    def places(source, *made):
        for m in made:
            (tmp_path / m).mkdir(parents=True, exist_ok=True)
        return Manifest(passage_sources=[source]).passages_at(str(tmp_path / "i"))

    (tmp_path / "i").mkdir()
    assert places({"path": str(tmp_path / "far")}, "far") == [str(tmp_path / "far")]
    assert places({"path": "near"}, "i/near") == [str(tmp_path / "i/near")]
    monkeypatch.chdir(tmp_path)
    assert places({"path": "here"}, "here") == [str(tmp_path / "here")]
    assert places({"path": "/gone/x", "path_relative": "sub/x"}, "i/sub/x") == [str(tmp_path / "i/sub/x")]
    assert places({"path": "/gone/passages"}, "i/passages") == [str(tmp_path / "i/passages")]


def test_store(spark, tmp_path):
    store, at = Store(spark), f"file://{tmp_path}/a/b.txt"
    store.write(at, "é text")
    assert store.exists(at) and store.read(at) == "é text"
    store.rename(f"file://{tmp_path}/a", f"file://{tmp_path}/c")
    store.delete(f"file://{tmp_path}/c")
    assert not store.exists(at)


class Notes(apps.App):
    name = "notes"

    def arguments(self, parser: argparse.ArgumentParser) -> None:
        parser.add_argument("--word", default="tea")

    def load(self, spark, options):
        return spark.createDataFrame([("Green tea grows on hills.",), (f"Nobody drinks {options.word} at noon.",)], "text string")


def test_applications(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("VECTRINE_HOME", str(tmp_path / "home"))
    with pytest.raises(TypeError):
        apps.App()
    where = str(tmp_path / "i")
    assert Notes().run(spark, ["--index", where, "--backend", "flat", "--query", "Green tea grows on hills.", "--top-k", "1"]) == [
        "Green tea grows on hills."
    ]
    assert index.exists(spark, where)
    assert len(Notes().run(spark, ["--index", where, "--query", "tea", "--llm", "simulated"])) == 1
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("A file about lakes.")
    assert apps.ReaderApp("files").run(
        spark, ["--index", str(tmp_path / "j"), "--path", str(tmp_path / "d"), "--query", "lakes", "--top-k", "1"]
    ) == ["A file about lakes."]
    assert set(apps.READERS) >= {"files", "code", "mail", "mailbox", "history", "chat"}
    said = []
    assert index.Chat(spark, where, {"type": "simulated"}).loop(
        ["", "what is green?\n", "quit\n", "never asked"], said.append
    ) == 1 and len(said) == 1


def test_memory_is_measured(spark):
    assert evaluate.memory_of_this_process() > 10
    rows = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 9.0), ("a", 3, 7.0)], "run string, at int, mb double")
    assert [tuple(r) for r in evaluate.memory(rows, "run", "mb", "at").collect()] == [("a", 9.0, 4.0)]


def test_mean_pool_of_a_group_without_marks(spark):
    rows = spark.createDataFrame([("a", [1.0, 2.0], 0), ("b", [1.0, 2.0], 1), ("b", [3.0, 6.0], 0)], "g string, v array<double>, m int")
    got = {(r["g"], r["at"]): r["value"] for r in embed.mean_pool(rows, "g", "v", "m").collect()}
    assert got == {("a", 0): 0.0, ("a", 1): 0.0, ("b", 0): 1.0, ("b", 1): 2.0}
    assert embed.mean_pool(rows, "g", "v").where("g = 'b' and at = 1").first()["value"] == 4.0


def test_local_files_are_read_without_a_list_of_paths(spark, tmp_path, monkeypatch):
    """Spark looks up each path of a list, one of each file; names with signs of patterns, links and empty files are read as they are."""
    from vectrine.sources import files

    (tmp_path / "a").mkdir()
    for name, text in (("a/x[1].txt", "one"), ("b.txt", ""), (".c.txt", "hidden"), ("d.bin", "other")):
        (tmp_path / name).write_text(text)
    (tmp_path / "e.txt").symlink_to(tmp_path / "a/x[1].txt")
    monkeypatch.setattr(files, "_escaped", None)
    found = {r["file_name"]: (r["file_path"], r["size"], r["text"]) for r in files.read(spark, [str(tmp_path)], [".txt"]).collect()}
    assert found == {
        "x[1].txt": (f"{tmp_path}/a/x[1].txt", 3, "one"), "b.txt": (f"{tmp_path}/b.txt", 0, ""), "e.txt": (f"{tmp_path}/e.txt", 3, "one")
    }
