"""The data source of mixed files: parsers as plug-ins, errors as rows, batch and stream."""

import io
import time
import zipfile

import pytest

from stratamem.sources import plugin

NOTE = '{".note": "paragraphs"}'
WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(text):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{WORD}"><w:body><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:body></w:document>')
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "mixed"
    (root / "deep").mkdir(parents=True)
    (root / "_temporary").mkdir()
    files = {"a.note": b"one\n\ntwo\n\n \n\nthree", "b.md": "# Ä\nbody\n## Next\nmore".encode(), "deep/c.py": b"def f():\n    return 1\n",
             "deep/d.js": b"function g() { return 2 }\n", "e.html": b"<body><h1>T</h1><p>text</p></body>", "f.docx": docx("plain words"),
             "g.docx": b"no archive", "h.bin": b"\x00\x01", "README": b"no suffix", "i.md": b"\xff\xfe broken", "j.note": b"",
             "_temporary/x.md": b"# hidden\nx", ".hidden.md": b"# hidden\nx"}
    for name, data in files.items():
        (root / name).write_bytes(data)
    return root


def rows_of(frame):
    return sorted((r["source"].rsplit("/", 1)[-1], r["parser"], r["section_index"], r["content"], r["error"] is not None)
                  for r in frame.collect())


def test_mixed_folder(spark, folder):
    got = rows_of(plugin.read_sections(spark, str(folder), parsers=NOTE))
    assert [g for g in got if g[0] == "a.note"] == [("a.note", ".note", i, t, False) for i, t in enumerate(["one", "two", "three"])]
    assert [g[3] for g in got if g[0] == "b.md"] == ["body", "more"]
    assert [g[1:] for g in got if g[0] == "c.py"] == [(".py", 0, "def f():\n    return 1", False)]
    assert [g[1] for g in got if g[0] == "d.js"] == ["code"]
    assert [g[3] for g in got if g[0] == "e.html"] == ["text"] and [g[3] for g in got if g[0] == "f.docx"] == ["plain words"]
    assert sorted(g[0] for g in got if g[4]) == ["README", "g.docx", "h.bin"]
    assert [g[3] for g in got if g[0] == "i.md"] == ["�� broken"]
    assert not [g for g in got if g[0] in ("j.note", "x.md", ".hidden.md")]


def test_files_are_dealt_by_size():
    files = [(i, f"f{i}", size) for i, size in enumerate([10, 10, 5 << 20, 10, 10])]
    assert [len(g.paths) for g in plugin.dealt(files, 3 << 20)] == [2, 1, 2]
    assert plugin.dealt([], 1) == []


def test_a_folder_is_read_once_in_few_tasks(spark, folder):
    frame = plugin.read_sections(spark, str(folder), parsers=NOTE)
    assert frame._jdf.queryExecution().executedPlan().toString().count("BatchScan") == 1
    many = plugin.FilesReader({"path": str(folder)})
    assert 1 < len(many.partitions()) <= 13
    # Some hundred small files to a task.
    assert len(plugin.dealt([(i, f"f{i}", 3000) for i in range(50_000)], plugin.PARTITION_BYTES)) < 110


def test_pieces_of_raw_files_keep_their_place(spark, tmp_path):
    from stratamem.sources import documents
    bodies = {"a.md": "intro\n# One\n\n## Two\ntext", "b.js": "// preface\nfunction f() {}\nclass G {}\n", "c.ts": "let x = 1", "d.js": " \n",
              "e.md": "", "f.markdown": "# only a heading"}
    for name, body in bodies.items():
        (tmp_path / name).write_text(body)
    got = plugin.read_sections(spark, str(tmp_path))
    texts = spark.createDataFrame([(f"{tmp_path}/{n}", b) for n, b in bodies.items()], "source string, body string")
    markdown = texts.filter(texts.source.endswith("md") | texts.source.endswith("markdown"))
    want = documents.markdown_sections(markdown, "body", ["source"]).unionByName(
        documents.sliced_code(texts.subtract(markdown), "source", "body", ["source"]))
    names = ("source", "section_index", "content", "title", "metadata")

    def rows(frame):
        return sorted(([r[n] for n in names] for r in frame.collect()), key=str)
    assert rows(got) == rows(want) and len(rows(want)) == 5


def test_an_empty_folder_and_an_unknown_parser(spark, tmp_path):
    assert plugin.read_sections(spark, str(tmp_path / "absent")).collect() == []
    with pytest.raises(Exception, match="nowhere"):
        plugin.read_sections(spark, str(tmp_path), parsers='{".x": "nowhere:f"}').collect()


def test_stream_takes_new_files_once(spark, folder, tmp_path):
    out = str(tmp_path / "out")

    def drain():
        stream = plugin.stream_sections(spark, str(folder), parsers=NOTE)
        query = (stream.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").option("path", f"{out}/data")
                 .outputMode("append").trigger(once=True).start())
        query.awaitTermination()
        return rows_of(spark.read.schema(plugin.SCHEMA).parquet(f"{out}/data"))
    first = drain()
    assert first == rows_of(plugin.read_sections(spark, str(folder), parsers=NOTE))
    time.sleep(0.05)
    (folder / "new.note").write_bytes(b"late")
    assert sorted(set(drain()) - set(first)) == [("new.note", ".note", 0, "late", False)] and len(drain()) == len(first) + 1
