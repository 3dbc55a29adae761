"""Builders of small inputs."""

LINES = "doc_id long, page_num int, line_ord int, text string, left int, top int, right int, bottom int, block_num int, par_num int, page_width int, page_height int, confidence double"


def lines(spark, *pages, doc_id=1, width=1000, height=1400, box=None):
    """pages: lists of texts, or of (text, left, top, right, bottom)."""
    rows = []
    for p, texts in enumerate(pages, 1):
        for i, x in enumerate(texts):
            text, left, top, right, bottom = x if isinstance(x, tuple) else (x, 80, 100 + 40 * i, 80 + 10 * len(x), 124 + 40 * i)
            rows.append((doc_id, p, i, text, left, top, right, bottom, i + 1, 1, width, height, 95.0))
    return spark.createDataFrame(rows, LINES)


def tables(spark, *tables, doc_id=1):
    """tables: (page_num, rows)."""
    rows = [(doc_id, f"page_{p:03d}_table_{i:02d}", p, r) for i, (p, r) in enumerate(tables, 1)]
    return spark.createDataFrame(rows, "doc_id long, table_id string, page_num int, rows array<array<string>>")
