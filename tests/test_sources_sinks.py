"""Readers, writers, passages, judged calls and column expressions."""

import json

import pytest
from pyspark.sql import functions as F

from quirework.functions import shapes as S
from quirework.functions.chunking import chunked, passages
from quirework.operators.judged import Canned, judged, parse_json
from quirework.sources import files, sinks


def test_scan_folder(spark, tmp_path):
    for name, text in (("a.pdf", "one"), ("b.pdf", "two"), ("c.docx", "three"), ("d.txt", "four"), ("e.pdf", "five")):
        (tmp_path / name).write_text(text)
    import hashlib

    h = {n: hashlib.sha256(t.encode()).hexdigest() for n, t in (("a", "one"), ("b", "two"), ("c", "three"), ("e", "five"))}
    ledger = spark.createDataFrame([(f"a-{h['a'][:12]}", h["a"]), ("b-000000000000", "0" * 64), (f"e-{h['e'][:12]}", h["e"])], "source_id string, hash string")
    have = spark.createDataFrame([(f"a-{h['a'][:12]}", x) for x in files.ARTIFACTS] + [(f"e-{h['e'][:12]}", "tree")], "source_id string, artifact string")
    got = {r.path.rpartition("/")[2]: (r.status, r.missing) for r in files.scan_folder(spark, str(tmp_path), ledger, have).collect()}
    assert got == {"a.pdf": ("done", None), "b.pdf": ("changed", None), "c.docx": ("new", None), "d.txt": ("rejected", None), "e.pdf": ("partial", "chunks,answers,envelope")}


def test_append_log(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    log.write_text('{"k": "a", "v": 1}\n{"k": "a", "v": 2}\n{"k": "b", "v"')
    rows = files.append_log(spark, str(log), "k string, v bigint")
    assert [(r.k, r.v) for r in rows.collect()] == [("a", 1), ("a", 2)]
    assert [(r.k, r.v) for r in files.decisions(rows, ["k"], "v").collect()] == [("a", 2)]
    log.write_text('{"k": "a", "v"\n{"k": "b", "v": 2}\n')
    with pytest.raises(Exception, match="corrupt line"):
        files.append_log(spark, str(log), "k string, v bigint").collect()


def test_notes_and_records(spark, tmp_path):
    (tmp_path / "n").mkdir()
    (tmp_path / "n/a.md").write_text("---\nid: 1\n---\nBody\n")
    (tmp_path / "n/b.md").write_text("No front\n---\nmatter")
    got = {r.path.rpartition("/")[2]: (r.front, r.body.strip()) for r in files.notes_with_front_matter(spark, str(tmp_path / "n")).collect()}
    assert got == {"a.md": ("id: 1", "Body"), "b.md": (None, "No front\n---\nmatter")}
    (tmp_path / "r").mkdir()
    for i, x in enumerate(({"kind": "x", "n": 1}, {"n": 2})):
        (tmp_path / f"r/{i}.json").write_text(json.dumps(x))
    assert [r.n for r in files.records_with(spark, str(tmp_path / "r"), "kind", "kind string, n int").collect()] == [1]


def test_store_round_trip(spark, tmp_path):
    tables = {"notes": spark.range(5).toDF("id"), "names": spark.range(0).toDF("id")}
    assert sinks.write_store(tables, str(tmp_path), "v1") == {"notes": 5, "names": 0}
    assert sinks.read_store(spark, str(tmp_path), "v1")["notes"].count() == 5
    with pytest.raises(FileExistsError):
        sinks.write_store(tables, str(tmp_path), "v1")


def test_changes_and_purge(spark):
    old = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None)], "k string, v string")
    new = spark.createDataFrame([("a", "x"), ("b", "z"), ("c", None), ("d", "w")], "k string, v string")
    assert {(r.k, r.change) for r in sinks.changes(new, old.filter("k <> 'a'").union(old.filter("k = 'a'")), "k", "v").collect()} == {("b", "update"), ("d", "insert")}
    assert {(r.k, r.change) for r in sinks.changes(old.limit(0), old, "k", "v").collect()} == {(k, "delete") for k in "abc"}
    assert sinks.purge(old, new.filter("k = 'b'"), ["k"]).count() == 2


def test_ledger_and_sections(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "s string, n int")
    sinks.append_rows(df, str(tmp_path / "l"))
    sinks.append_rows(df, str(tmp_path / "l"))
    assert spark.read.csv(str(tmp_path / "l"), sep="\t", header=True).count() == 2
    page = spark.createDataFrame([("# T\n\n## Finding\n\nold\n\n## Next\n\nx\n", "cost $5"), ("# T\n", "new")], "t string, b string")
    got = [r[0] for r in page.select(sinks.upsert_section("t", "Finding", "b")).collect()]
    assert "old" not in got[0] and "cost $5" in got[0] and "## Next" in got[0] and got[1].endswith("## Finding\n\nnew\n")


def test_passages(spark):
    assert passages(None) == [] and passages("  ") == []
    text = "\n\n".join(("Sentence one here. " * 30).strip() for _ in range(40)) + "\n\n" + "x" * 25_000
    got = passages(text)
    assert all(len(p) <= 9000 for p in got) and all(len(p) >= 3500 for p in got[:-1])
    assert "".join("".join(got).split()) == "".join(text.split())
    df = spark.createDataFrame([(1, text), (2, None), (3, "short")], "id bigint, text string")
    rows = chunked(df, "id", "text").collect()
    assert [r.n for r in rows if r.id == 1] == list(range(1, len(got) + 1)) and not [r for r in rows if r.id == 2]


def test_judged(spark):
    assert parse_json('```json\n{"a": "b\\q"}\n```') == {"a": "b\\q"} and parse_json("[1]") is None and parse_json("no") is None
    df = spark.createDataFrame([(1, "p1"), (2, "p2"), (3, None)], "id int, prompt string")
    got = {r.id: (r.answer, r.error) for r in judged(df, "id", "prompt", lambda: Canned({"p1": '{"ok": true}'}), lambda a: "ok" in a).collect()}
    assert got == {1: ('{"ok": true}', None), 2: (None, "not valid"), 3: (None, "no prompt")}


def test_shapes(spark):
    def one(expr, value):
        return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x"))).first()[0]

    assert one(S.folded, "Ba'th-Party  ʿAmmaan") == "bath party amman"
    for title, want in (("154 Notes", True), ("1984 Reforms", False), ("V. Articles and Periodicals", True), ("I. The Origins", False), ("Selected Bibliography", True), ("Appendix A", True), ("Notes to Pages 3-5", True), (None, False)):
        assert one(S.no_evidence, title) is want
    for surface, want in (("Figure 3", True), ("Chapter four", True), ("1990-95", True), ("ibid.", True), ("Mann (1986)", True), ("[34]", True), ("19th century", True), ("Mapping Power", False), ("Ibidem Press", False)):
        assert one(S.cut_from_names, surface) is want
    assert one(S.skip_reason, "1234567890 abc") == "letters" and one(S.skip_reason, "a" * 30_001) == "size" and one(S.skip_reason, "") is None
    assert one(S.slug, " The Making: of It! ") == "the-making-of-it" and one(S.slug, "!!") == "section"
    assert one(S.year_of, "x-1999-2001-0123456789ab") == 2001
    assert one(S.isbn13, "9780306406157") is True and one(S.isbn13, "9780306406158") is False and one(S.isbn13, "0" * 13) is False


def test_unreadable_records_are_rows_of_nulls(spark, tmp_path):
    for name, text in (("a", '{"kind": "x", "n": 1}'), ("b", '{"n": 2}'), ("c", '{"kind": ')):
        (tmp_path / f"{name}.json").write_text(text)
    got = {r.path.rpartition("/")[2]: r.n for r in files.records_with(spark, str(tmp_path), "kind", "kind string, n int").collect()}
    assert got == {"a.json": 1, "c.json": None}
