"""Lines, furniture, blocks and chunks on small pages."""

from reportmill.operators import chunking, layout


def items(spark, rows):
    data = [("d", p, i, s, [size, 0.0, 0.0, size, x, y], w, size, None) for i, (p, s, x, y, w, size) in enumerate(rows)]
    return spark.createDataFrame(data, layout.ITEM_SCHEMA)


def test_lines_cells_and_order(spark):
    rows = [(1, "b", 300.0, 700.2, 10.0, 10.0), (1, "a", 50.0, 700.0, 10.0, 10.0), (1, "next", 62.0, 700.0, 20.0, 10.0), (1, "low", 50.0, 680.0, 20.0, 10.0), (1, "  ", 50.0, 660.0, 5.0, 10.0)]
    found = layout.lines(items(spark, rows)).orderBy("line_ix").collect()
    assert [r["text"] for r in found] == ["a next  b", "low"]
    assert [c["text"] for c in found[0]["cells"]] == ["a next", "b"]


def test_wide_runs_split_into_cells(spark):
    found = layout.lines(items(spark, [(1, "Test    Value     Units", 0.0, 10.0, 230.0, 10.0)])).first()
    assert [c["text"] for c in found["cells"]] == ["Test", "Value", "Units"]
    assert [c["x"] for c in found["cells"]] == [0.0, 80.0, 180.0]


def test_line_keeps_its_first_baseline(spark):
    rows = [(1, t, 10.0 * i, 100.0 - 4.0 * i, 5.0, 10.0) for i, t in enumerate("abc")]
    assert layout.lines(items(spark, rows)).count() == 2


def test_table_heading_and_paragraph(spark):
    rows = [(1, "RESULTS", 50.0, 700.0, 60.0, 10.0)]
    for k, (a, b, c) in enumerate([("Test", "Value", "Units"), ("ALT", "90", "IU/L"), ("AST", "70", "IU/L")]):
        rows += [(1, t, x, 680.0 - 14 * k, 30.0, 10.0) for t, x in ((a, 50.0), (b, 200.0), (c, 300.0))]
    rows += [(1, "Seen today and", 50.0, 600.0, 90.0, 10.0), (1, "well.", 50.0, 588.0, 30.0, 10.0)]
    found = layout.extract(items(spark, rows), spark.createDataFrame([("d", 1)], "doc_id string, page int")).orderBy("block_ix").collect()
    assert [r["kind"] for r in found] == ["heading", "table", "paragraph"]
    assert found[1]["text"] == "Test | Value | Units\nALT | 90 | IU/L\nAST | 70 | IU/L"
    assert found[2]["text"] == "Seen today and well."
    assert found[0]["level"] == 3


def test_running_headers_go(spark):
    lines = [("d", p, i, 800.0 - 100 * i, 10.0, [], t) for p in (1, 2, 3) for i, t in enumerate([f"Page {p} of 3", f"Body {'x' * p}", "Middle", "Lower"])]
    found = spark.createDataFrame(lines, layout.LINE_SCHEMA)
    pages = spark.createDataFrame([("d", p) for p in (1, 2, 3, 4)], "doc_id string, page int")
    kept = layout.strip_furniture(found, pages)
    assert kept.filter("text like 'Page%' or text = 'Lower'").count() == 0
    assert kept.count() == 6


def test_scanned_pages_and_ocr(spark):
    it = items(spark, [(1, "enough text on this page", 0.0, 0.0, 1.0, 9.0), (3, "12", 0.0, 0.0, 1.0, 9.0)])
    pages = spark.createDataFrame([("d", 1), ("d", 2), ("d", 3)], "doc_id string, page int")
    assert sorted(r["page"] for r in layout.scanned_pages(it, pages).collect()) == [2, 3]
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    schema = f"doc_id string, page int, line_ix int, word_ix int, text string, confidence double, word_bbox {box}, line_bbox {box}, scale double, page_height double"
    words = [("d", 1, 0, i, t, c, (100.0 * i, 0.0, 100.0 * i + 80, 40.0), (0.0, 0.0, 400.0, 40.0), 2.0, 792.0) for i, (t, c) in enumerate([("ALT", 90.0), (" ", 90.0), ("x", 20.0)])]
    found = layout.ocr_items(spark.createDataFrame(words, schema)).collect()
    assert [(r["str"], r["height"], r["transform"][5]) for r in found] == [("ALT", 20.0, 772.0)]


def paragraph(text, page=1, ix=0):
    return {"kind": "paragraph", "text": text, "page": page, "level": None, "rows": None, "block_ix": ix}


def test_chunks_overlap_and_number_by_page():
    text = " ".join(f"Sentence number {i} says a little." for i in range(80))
    made = chunking.chunk_blocks([paragraph(text), paragraph("End.", 2)], 300, 40)
    assert [c["chunk_id"] for c in made] == [f"p1#{i + 1}" for i in range(len(made))]
    assert all(b["text"].split()[0] in a["text"] for a, b in zip(made, made[1:], strict=False))
    assert made[-1]["end_page"] == 2


def test_tables_repeat_their_header_and_sections_nest():
    rows = [["Test", "Value"]] + [[f"T{i}", str(i)] for i in range(30)]
    heads = [{"kind": "heading", "text": t, "level": lv, "page": 1, "rows": None} for t, lv in (("A", 1), ("B", 2), ("C", 2))]
    made = chunking.chunk_blocks([*heads, {"kind": "table", "rows": rows, "page": 1, "text": ""}], 60, 10)
    assert len(made) > 3 and all(c["text"].startswith("Test | Value\n") for c in made)
    assert made[0]["headings"] == ["A", "C"]


def test_long_words_stay_whole():
    assert chunking.split_prose("x" * 50, 10) == ["x" * 50]
    assert chunking.split_prose("aa bb. " + "c" * 12 + " dd", 8) == ["aa bb.", "c" * 12, "dd"]
    assert chunking.tail("one two three", 8) == "three"


def test_document_chunks(spark):
    docs = spark.createDataFrame([(1, "First line.\n\nSecond line."), (2, None)], "doc_id long, text string")
    made = chunking.chunks(chunking.document_blocks(docs)).collect()
    assert [(r["doc_id"], r["text"]) for r in made] == [("1", "First line. Second line.")]


def test_blocks_deal_a_pages_lines_once(spark):
    """The lines' walk stands once in the plan, and blocks count their lines."""
    rows = [("d", 1, i, t, [10.0, 0.0, 0.0, 10.0, 50.0, -14.0 * i], 50.0, 10.0, None) for i, t in enumerate(["HEAD", "one", "two", "Large", "three"])]
    rows[3] = (*rows[3][:4], [20.0, 0.0, 0.0, 20.0, 50.0, -42.0], 50.0, 20.0, None)
    made = layout.blocks(layout.lines(spark.createDataFrame(rows, layout.ITEM_SCHEMA)), n_lines=True)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2
    got = [(r["kind"], r["level"], r["text"], r["n_lines"]) for r in made.orderBy("block_ix").collect()]
    assert got == [("heading", 3, "HEAD", 1), ("paragraph", None, "one two", 2), ("heading", 1, "Large", 1), ("paragraph", None, "three", 1)]
