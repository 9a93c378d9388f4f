"""Document sources."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from stratamem.sources import documents as src
from stratamem.sources.html import page_sections


def markdown(spark, body):
    df = spark.createDataFrame([(1, body)], "id int, body string")
    return [(r.title, r.content) for r in src.markdown_sections(df, "body", ["id"]).orderBy("section_index").collect()]


def test_markdown_sections(spark):
    assert markdown(spark, "intro\n\n# A \ntext a\r\n## B\nb1\n#nospace\n####### seven\n```\n# in code\n```\n# Empty\n") == [
        ("Introduction", "intro"), ("A", "text a"), ("B", "b1\n#nospace\n####### seven\n```"), ("in code", "```")]
    assert markdown(spark, "# Only\nx\x0b# Next\u2028y") == [("Only", "x"), ("Next", "y")]
    assert markdown(spark, "") == []


def test_python_code(spark):
    body = ('import os\n\nclass A:\n    """Doc of A."""\n    def m(self):\n        return 1\n\n'
            "async def f():\n    pass\n")
    got = src.python_sections("/x/mod.py", body)
    assert [(s["title"], s["metadata"]["line_start"]) for s in got] == [("A", "3"), ("f", "8"), ("m", "5")]
    assert got[0]["metadata"]["docstring"] == "Doc of A." and got[1]["content"] == "async def f():\n    pass"
    assert [s["title"] for s in src.python_sections("/x/bad.py", "def (")] == ["bad.py"]
    assert src.python_sections("s.py", "x = 1")[0]["content"] == "x = 1"


def test_other_code(spark):
    body = "// head\nexport async function go(a) {}\n\nclass K {\n}\n  function inner() {}\npub fn z() {}\n"
    df = spark.createDataFrame([(1, "lib/a.ts", body), (2, "b.toml", "k = 1\n")], "id int, path string, body string")
    got = src.read_code(df, "path", "body", ["id"]).orderBy("id", "section_index").collect()
    assert [(r.id, r.title) for r in got] == [(1, "go"), (1, "K"), (1, "z"), (2, "b.toml")]
    assert got[1].content == "class K {\n}\n  function inner() {}"
    assert got[0].metadata == {"language": "ts", "file": "lib/a.ts", "name": "go"}


HTML = """<html><head><title> T &amp; x </title><script>var a = "<p>no</p>";</script></head><body>
<nav><p>menu</p></nav><main><p>before<h1>One <b>bold</b></h1><p><b>a<br><p>b<!-- c --></p>
<ul><li>l1<li><p>l2</p></ul><h5>five</h5><h2>Two</h2><pre> code
x </pre><footer><p>no</p></footer></main><p>outside</p></body></html>"""


def test_html_sections():
    got = [(s["title"], s["content"]) for s in page_sections("http://u", HTML)]
    assert got == [("T & x", "before"), ("One bold", "a\nb\nl1\nl2\nl2"), ("Two", "code\nx")]


@pytest.mark.parametrize("html,title,content", [
    ("<p>a</p><article><p>b</p></article>", "u", "b"),
    ("<body><div id='Main-Content'><p>b</p></div><p>c</p></body>", "u", "b"),
    ("<html><title>t</title><body>plain <i>text</i></body></html>", "t", "plain\ntext"),
    ("no tags", "u", "no tags"),
])
def test_html_main_area_and_fallback(html, title, content):
    got = page_sections("u", html)
    assert [(s["title"], s["content"]) for s in got] == [(title, content)]


def test_every_page_keeps_its_article_text(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = src.read_html(pages, "url", "html", ["page_id"]).groupBy("page_id").agg(F.count("*").alias("n"))
    assert got.count() == pages.count()
    menu = src.read_html(pages, "url", "html", ["page_id"]).filter(F.col("content").contains("track("))
    assert menu.count() == 0


def docx(paragraphs):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    def para(text, style=None):
        mark = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
        return f"<w:p>{mark}<w:r><w:t>{text}</w:t></w:r></w:p>"
    body = "".join(p if p.startswith("<w:tbl>") else para(*p.split("|")) for p in paragraphs)
    styles = (f'<w:styles {ns}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", styles)
    return out.getvalue()


def test_docx_sections(spark, tmp_path):
    cell = "<w:tc><w:p><w:r><w:t>{}</w:t></w:r></w:p></w:tc>".format
    table = f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('')}{cell('')}</w:tr></w:tbl>"
    data = docx(["lead", "Title|H1", "body", table, "1. Numbered", "x", "12 " + "long" * 30, "Empty|H1"])
    want = [("Introduction", "lead"), ("Title", "body\na | b"), ("1. Numbered", "x\n12 " + "long" * 30)]
    assert [(s["title"], s["content"]) for s in src.docx_sections(data)] == want


def test_read_files_routes_by_suffix(spark, tmp_path):
    (tmp_path / "a.md").write_text("# H\nbody")
    (tmp_path / "b.py").write_text("def f():\n    pass\n")
    (tmp_path / "c.docx").write_bytes(docx(["text"]))
    got = {(r.source.rsplit("/", 1)[-1], r.title) for r in src.read_files(spark, str(tmp_path)).collect()}
    assert got == {("a.md", "H"), ("b.py", "f"), ("c.docx", "Introduction")}


def test_unknown_files_raise(spark, tmp_path):
    (tmp_path / "a.bin").write_text("x")
    with pytest.raises(Exception, match="no parser for"):
        src.read_files(spark, str(tmp_path)).collect()


def test_page_text(spark):
    df = spark.createDataFrame([("f", 1, 2, "a\n\nb\n\nc\n\nd"), ("f", 2, 2, " ")], "source string, page int, total_pages int, t string")
    got = src.page_text_sections(df, "t", ["source"]).collect()
    assert sorted((r.title, r.content) for r in got) == [("Page 1", "a\n\nb\n\nc"), ("Page 1", "d")]


def test_a_bad_source_fails_alone(spark):
    from stratamem.plans import ingest
    from stratamem.sources import documents, html
    deep = "<div>" * 5000 + "deep text"
    assert html.page_sections("u", deep)[0]["content"] == "deep text"
    assert len(html.page_sections("u", "word " * 5000)[0]["content"]) > 20_000
    assert len(html.page_sections("u", "word " * 5000, 8000)[0]["content"]) == 8000
    code = "x = " + "(" * 5000 + "1" + ")" * 5000
    assert documents.python_sections("deep.py", code)[0]["content"] == code
    files = spark.createDataFrame([("bad.docx", bytearray(b"no zip"))], "source string, data binary")
    broken = documents.read_docx(files, "source", "data", ["source"])
    row, = broken.collect()
    assert row["content"] is None and row["metadata"]["error"].startswith("BadZipFile")
    good = spark.createDataFrame([("a.md", "# T\ntext")], "source string, body string")
    both = broken.unionByName(documents.markdown_sections(good, "body", ["source"]))
    counts = {r["source"]: (r["chunks_stored"], r["chunks_failed"], r["total_chunks"])
              for r in ingest.ingest_result(both, "source").collect()}
    assert counts == {"bad.docx": (0, 1, 1), "a.md": (1, 0, 1)}


def test_parsers_can_be_added(spark, tmp_path):
    from pyspark.sql import functions as F
    from stratamem.sources import documents
    (tmp_path / "a.log").write_text("line")
    (tmp_path / "b.md").write_text("# T\nbody")
    own = {".log": lambda d: d.select("source", F.lit(0).alias("section_index"), F.col("body").alias("content"),
                                      F.lit("log").alias("title"), F.create_map(F.lit("k"), F.lit("v")).alias("metadata"))}
    got = {r["title"]: r["content"] for r in documents.read_files(spark, str(tmp_path), own).collect()}
    assert got == {"log": "line", "T": "body"}


def test_code_slices_stay_in_the_jvm(spark):
    body = "import x\nexport async function one() {\n}\nclass Two {}\n  def no\npub fn drei(a)\n"
    rows = spark.createDataFrame([(1, "a/b.TS", body), (2, "c.go", "nothing here"), (3, "d.js", "func x\n\n")],
                                 "id long, path string, body string")
    out = src.sliced_code(rows, "path", "body", ["id"])
    got = [(r["id"], r["section_index"], r["title"], r["content"], r["metadata"]["language"]) for r in out.collect()]
    assert got == [(1, 0, "one", "export async function one() {\n}", "ts"), (1, 1, "Two", "class Two {}\n  def no", "ts"),
                   (1, 2, "drei", "pub fn drei(a)", "ts"), (2, 0, "c.go", "nothing here", "go"), (3, 0, "x", "func x", "js")]
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
