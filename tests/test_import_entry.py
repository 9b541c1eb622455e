from email.message import EmailMessage

from pagemill.sources.files import import_documents


def _eml_multipart():
    m = EmailMessage()
    m["Subject"] = "Report"
    m["From"] = "a@example.com"
    m["To"] = "b@example.com"
    m.set_content("plain body\n")
    m.add_attachment(b"not text", maintype="application", subtype="octet-stream", filename="x.bin")
    return m.as_bytes()


def test_import_files(spark):
    mbox = (b"From x@example.com\nFrom: a@example.com\nSubject: First\n\nHello one\n\n"
            b"From y@example.com\nFrom: b@example.com\n\nHello two\n")
    files = [
        ("/u/notes.txt", b"line one   \n\n\n\n\nline two\xff\xfe\n"),
        ("/u/page.html", b"<html><head><title>T</title></head><body><nav>menu</nav><article><p>Body text</p></article></body></html>"),
        ("/u/untitled.htm", b"<p>Just a paragraph</p>"),
        ("/u/data.csv", b"a,b\n1,2\n"),
        ("/u/README", b"readme"),
        ("/u/mail.eml", _eml_multipart()),
        ("/u/box.mbox", mbox),
    ]
    df = spark.createDataFrame(files, "path string, content binary")
    docs = {r["source"]: r for r in import_documents(df).collect()}
    t = docs["notes.txt"]
    assert t["body_markdown"] == "line one\n\nline two��\n" and t["meta"]["type"] == "text"
    assert docs["page.html"]["title"] == "T" and docs["page.html"]["body_markdown"] == "Body text\n"
    assert docs["untitled.htm"]["title"] == "untitled.htm"
    assert docs["data.csv"]["meta"]["note"] == "Unknown extension treated as text"
    assert docs["README"]["meta"]["type"] == "text"
    e = docs["mail.eml"]
    assert e["title"] == "Report" and e["body_markdown"].startswith("**From:** a@example.com\n**To:** b@example.com\n\nplain body")
    assert docs["box.mbox#1"]["title"] == "First" and docs["box.mbox#2"]["title"] == "Message 2"
    assert "**To:** Unknown" in docs["box.mbox#2"]["body_markdown"] and docs["box.mbox#2"]["meta"]["index"] == "2"


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["doc_id", "text"]
    qs, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(qs) and len(qs) >= 50


def test_entry_without_the_optional_folders(tmp_path):
    """The entry, its queries and statements import from a tree that has no training-data subpackage."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", "*.json")
    shutil.copytree(root, tmp_path / "tree", ignore=skip)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 50 and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "tree", check=True, timeout=120, env={**os.environ, "PYTHONPATH": ""})
