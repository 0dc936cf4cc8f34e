import io
import zipfile

from loreforge.operators.chunking import all_windows, chunk_text, greedy, pack, windows
from loreforge.sources.documents import marker, html_text, markdown_text, read_document, read_documents


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in files.items():
            z.writestr(k, v)
    return out.getvalue()


def test_chunks():
    assert chunk_text(None) == chunk_text(" \n\n ") == []
    assert chunk_text("one\n\n two \n \nthree") == ["one", "two", "three"]
    long = "Sentence number one is here. " * 60
    parts = chunk_text(long)
    assert all(len(p) <= 1000 for p in parts) and " ".join(parts) == long.strip()
    assert [len(x) for x in chunk_text("x" * 2500)] == [1000, 1000, 500]
    marked = chunk_text("intro\n\n⟦A⟧\n\np1\n\np2\n\n⟦B › C⟧\n\n" + "y" * 1200)
    assert marked[:2] == ["intro", "[A] p1\n\np2"] and all(len(x) <= 1000 and x.startswith("[B › C] ") for x in marked[2:])


def test_packing():
    assert greedy(["aa", "bb", "cccccc"], 5, " ") == ["aa bb", "ccccc", "c"]
    assert pack([5, 4, 30, 1], 11) == [0, 0, 1, 2]
    assert all_windows("a\nb\nc\n", 4) == ["a\nb\n", "c\n"] and all_windows(None) == [] and all_windows("a\u2028b\x0bc\n\nd", 4) == ["a\u2028b\x0bc\n", "\nd"]


def test_html():
    page = "<html><head><title>t</title></head><body><nav>menu</nav><h1>Top <i>x</i></h1><p>a  b<br>c<table><tr><td>1<td>2</table><pre>k  k</pre><script>no</script></body>"
    assert html_text(page) == "⟦Top x⟧\n\nTop x\n\na b\nc\n\n1\t2\n\nk  k"
    assert html_text(None) == ""


def test_markdown():
    got = markdown_text("# A\nx\n### C\n```\n# no\n```\n## B\n")
    assert [x for x in got.split("\n") if x.startswith("⟦")] == ["⟦A⟧", "⟦A › C⟧", "⟦A › B⟧"]


def test_formats(spark, tmp_path):
    w = 'xmlns:w="urn:w"'
    docx = zipped({"word/document.xml": f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p></w:body></w:document>'})
    slide = '<sld xmlns:a="urn:a"><a:p><a:r><a:t>s{}</a:t></a:r></a:p></sld>'
    pptx = zipped({f"ppt/slides/slide{i}.xml": slide.format(i) for i in (10, 2)})
    epub = zipped(
        {
            "META-INF/container.xml": '<c><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></c>',
            "o/c.opf": '<p><manifest><item id="a" href="a.html"/><item id="b" href="gone.html"/><item id="c" href="c.html"/></manifest><spine><itemref idref="a"/><itemref idref="b"/><itemref idref="c"/></spine></p>',
            "o/a.html": "<p>first</p>",
            "o/c.html": "<h1>Two</h1><p>second</p>",
        }
    )
    files = {"a.docx": docx, "b.pptx": pptx, "c.epub": epub, "d.txt": b"\xef\xbb\xbfhi\r\nyou", "e.bin": b"x", "f.txt": b"a\0b", "g.md": b"# T\nx", "h.docx": b"broken", "i.txt": b"  "}
    for k, v in files.items():
        (tmp_path / k).write_bytes(v)
    got = {r.path.rpartition("/")[2]: (r.text, r.error) for r in read_documents(spark, str(tmp_path)).collect()}
    assert got["a.docx"][0] == "⟦Head⟧\n\nHead\n\na\tb"
    assert got["b.pptx"][0] == "⟦slide 2⟧\n\ns2\n\n⟦slide 10⟧\n\ns10"
    assert got["c.epub"][0] == "⟦chapter 1⟧\n\nfirst\n\n⟦Two⟧\n\nTwo\n\nsecond"
    assert got["d.txt"] == ("hi\nyou", None) and got["g.md"][0].startswith("⟦T⟧")
    assert all(got[k][0] is None and got[k][1] for k in ("e.bin", "f.txt", "h.docx", "i.txt"))
    assert read_document("x.html", b"<p>q") == ("q", None)


def test_windows_say_what_went(spark):
    df = spark.createDataFrame([(1, "a\nb\nc\n"), (2, "x"), (3, None)], "id long, text string")
    got = sorted(tuple(r) for r in windows(df, "id", "text", 2, 2).select("id", "ordinal", "text", "dropped").collect())
    assert got == [(1, 0, "b\n", 1), (1, 1, "c\n", 1), (2, 0, "x", 0)]


def test_marker_is_cut():
    assert marker(" a\n b ") == "⟦a b⟧" and marker("x" * 80) == "⟦" + "x" * 80 + "⟧" and marker("x" * 81) == "⟦" + "x" * 80 + "…⟧"


def test_ingest(spark):
    from loreforge.operators import state, writing

    kind = "path string, space_id long, kind string, tags array<string>, title string, summary string, at int, seq int"
    rows = [("/d/Spec Auth v2.md", 1, None, ["x"], " ", " s ", 1, 1), ("/d/…", 1, "note", None, "T", None, 2, 2), ("/d/a.md", 1, "caption", [], None, None, 3, 3), ("/gone", 1, "", [], None, None, 4, 4), ("/bad", 1, "", [], None, None, 5, 5), ("/d/b.md", 1, "fact", ["file:b"], None, None, 6, 6), ("/blank", 1, "", [], None, None, 7, 7)]
    texts = [("/d/Spec Auth v2.md", "one", None), ("/d/…", "two", None), ("/d/a.md", "x", None), ("/bad", None, "BadZipFile: x"), ("/d/b.md", "three", None), ("/blank", " \n", None)]
    writes, refused = writing.ingest(spark.createDataFrame(rows, kind), spark.createDataFrame(texts, "path string, text string, error string"))
    assert sorted((r.ref, r.kind, r.tags, r.title, r.summary, r.source) for r in writes.collect()) == [
        ("/d/Spec Auth v2.md", "document", ["x", "file:spec-auth-v2"], "Spec Auth v2.md", "s", "ingest:/d/Spec Auth v2.md"),
        ("/d/b.md", "fact", ["file:b"], "b.md", "", "ingest:/d/b.md"),
        ("/d/…", "note", [], "T", "", "ingest:/d/…"),
    ]
    assert sorted(map(tuple, refused.collect())) == [("/bad", "BadZipFile: x"), ("/blank", "empty"), ("/d/a.md", "kind: caption"), ("/gone", "no such file")]
    none = state.fold_notes(spark.createDataFrame([], "space_id long, kind string, text string, tags array<string>, project string, why string, at int, seq int"))
    assert writing.write_notes(none, writes).notes.count() == 3
