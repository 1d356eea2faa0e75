"""Small cases of the operators, with results known in advance."""

from foliolake.functions import scalars as P
from foliolake.operators import chapters as C
from foliolake.operators import charmap as D
from foliolake.operators import layout as L
from foliolake.operators import stats as A
from foliolake.operators import textstruct as T
from foliolake.operators import trees as H
from foliolake.sources import files as S
from pyspark.sql import functions as F

SPAN = "doc_id long, page_no int, stream_id int, seq int, x double, y double, fs double, mono boolean, text string"
LINE = "doc_id long, page_no int, line_no int, x double, fs double, text string"


def test_spaces_and_indent(spark):
    at = [(14, -20, "Intro"), (14, -32, "fn"), (29, -32, "add"), (44, -32, "n:"), (59, -32, "i32"), (24, -44, "return"), (59, -44, "n")]
    spans = spark.createDataFrame([(1, 0, 0, i, 72.0 + x, 720.0 + y, 10.0, False, t) for i, (x, y, t) in enumerate(at)], SPAN)
    assert L.reading_text(spans).first()["text"].split("\n") == ["Intro", "fn addn: i32", "  return n"]


def test_gaps(spark):
    for x, n in ((10.4, 0), (15.6, 1), (60.0, 3)):
        spans = spark.createDataFrame([(1, 0, 0, 0, 0.0, 0.0, 10.0, False, "fn"), (1, 0, 0, 1, x, 0.0, 10.0, False, "a")], SPAN)
        assert L.infer_spaces(L.segment_lines(spans)).where("seq = 1").first()["n_spaces"] == n


def test_line_anchor_drifts(spark):
    spans = spark.createDataFrame([(1, 0, 0, i, 0.0, y, 10.0, False, "a") for i, y in enumerate((100.0, 98.0, 96.0))], SPAN)
    assert [r["line_no"] for r in L.segment_lines(spans).orderBy("seq").collect()] == [0, 0, 1]


def test_margin_and_indent(spark):
    lines = lambda xs: spark.createDataFrame([(1, 0, i, float(x), 10.0, t) for i, (x, t) in enumerate(xs)], LINE)
    indent = lambda d: [r["text"] for r in L.restore_indent(d, L.margin_supported(d, L.left_margin(d))).orderBy("line_no").collect()]
    assert indent(lines([(0, "a"), (0, "b"), (10, "c")])) == ["a", "b", "  c"]
    assert indent(lines([(100, "Centered Caption")])) == ["Centered Caption"]
    assert indent(lines([(0, "a"), (0, "b"), (400, "c")]))[2] == " " * 12 + "c"


def test_replay(spark):
    ops = [("BT",), ("Tf", [10.0], None, "Mono"), ("q",), ("cm", [1.0, 0, 0, 1, 0, 50]), ("Tm", [1.0, 0, 0, 1, 0, 10]), ("Tj", None, "Translated"), ("Q",), ("Tj", None, "Part"), ("TJn", [-300.0]), ("Tj", None, "A"), ("Do", [7.0])]
    floats = lambda x: None if x is None else [float(v) for v in x]
    rows = [(1, 0, 0, i, o[0], floats(o[1]) if len(o) > 1 else None, o[2] if len(o) > 2 else None, o[3] if len(o) > 3 else None) for i, o in enumerate(ops)] + [(1, 0, 7, 0, "Tj", None, "form", None)]
    got = L.replay_oplog(spark.createDataFrame(rows, "doc_id long, page_no int, stream_id int, seq int, op string, nums array<double>, str string, font string")).orderBy("seq").collect()
    assert [(r["text"], r["y"]) for r in got] == [("Translated", 60.0), ("Part", 10.0), (" ", None), ("A", 10.0), ("form", 0.0)]
    assert got[0]["mono"] and not got[4]["mono"]


OPS = "doc_id long, page_no int, stream_id int, seq int, op string, nums array<double>, str string, font string"


def replayed(spark, *streams):
    """Spans and images of one page; each stream is (number, operations)."""
    floats = lambda x: None if x is None else [float(v) for v in x]
    rows = [(1, 0, s, i, o[0], floats(o[1]) if len(o) > 1 else None, o[2] if len(o) > 2 else None, o[3] if len(o) > 3 else None) for s, ops in streams for i, o in enumerate(ops)]
    return L.replay_oplog(spark.createDataFrame(rows, OPS))


def test_blank_of_a_text_array(spark):
    ops = [("BT",), ("Tf", [12.0], None, "F1"), ("Td", [72, 660]), ("Tj", None, "Part"), ("TJn", [-300]), ("Tj", None, "A")]
    assert L.reading_text(replayed(spark, (0, ops)).drop("image")).first()["text"] == "Part A"
    # Before any text a blank hides where the line begins, so that the gap is from the page's edge.
    ops = [("BT",), ("Tf", [10.0], None, "F1"), ("Td", [22, 0]), ("TJn", [-300]), ("Tj", None, "A")]
    line = L.assemble_lines(L.infer_spaces(L.segment_lines(replayed(spark, (0, ops))))).first()
    assert (line["text"], line["x"], line["fs"]) == ("   A", None, 0.0)


def test_sizes_without_sign_and_mono_fonts(spark):
    ops = [("Tf", [-10.0], None, "Source Code Pro"), ("Td", [0, 0]), ("Tj", None, "one"), ("Td", [30, 0]), ("Tj", None, "two"), ("Tf", [0.0], None, "Georgia"), ("Tj", None, "z")]
    got = replayed(spark, (0, ops)).orderBy("seq").collect()
    assert [(r["fs"], r["mono"]) for r in got] == [(10.0, True), (10.0, True), (1.0, False)]
    signed = spark.createDataFrame([(1, 0, 0, i, 30.0 * i, 0.0, -10.0, False, t) for i, t in enumerate(("one", "two"))], SPAN)
    assert L.reading_text(signed).first()["text"] == "one two"


def test_lines_after_a_form(spark):
    """A form has an anchor of its own, and the page goes on from its own last line."""
    spans = [(0, 100.0, "a"), (7, 50.0, "f"), (7, 20.0, "g"), (0, 100.0, "b"), (0, 80.0, "c")]
    rows = spark.createDataFrame([(1, 0, s, i, 0.0, y, 10.0, False, t) for i, (s, y, t) in enumerate(spans)], SPAN)
    assert [r["line_no"] for r in L.segment_lines(rows).orderBy("seq").collect()] == [0, 0, 1, 1, 2]


def test_images_among_the_text(spark):
    page = [("BT",), ("Tf", [10.0], None, "F"), ("Tm", [1, 0, 0, 1, 0, 100]), ("Tj", None, "Above it"), ("Do", None, "pic"), ("Do", None, "bad"), ("Tm", [1, 0, 0, 1, 0, 80]), ("Tj", None, "Below"), ("Do", [7])]
    drawn = L.infer_spaces(L.segment_lines(replayed(spark, (0, page), (7, [("Do", None, "pic")]))))
    images = spark.createDataFrame([(1, "pic", "jpeg"), (1, "bad", "unsupported")], "doc_id long, image string, kind string")
    got = L.anchor_images(drawn, images).orderBy("img_seq")
    assert [(r["img_seq"], r["image"], r["line"], r["char_in_line"]) for r in got.collect()] == [(0, "pic", 0, 8), (2, "pic", 1, 5)]
    order = L.interleave_images(L.assemble_lines(drawn), got).orderBy("pos").collect()
    assert [(r["kind"], r["text"], r["img_seq"]) for r in order] == [("line", "Above it", None), ("image", None, 0), ("line", "Below", None), ("image", None, 2)]


def test_spans_of_many_pages_and_line_ends(spark):
    spans = [(1, p, 0, i, 60.0 * (i % 5), 700.0 - 14 * (i // 5), 10.0, False, "w\u3000") for p in range(3) for i in range(1500)]
    text = L.reading_text(spark.createDataFrame(spans, SPAN).repartition(4)).collect()
    assert len(text) == 3 and all(len(r["text"].split("\n")) == 300 and not r["text"].endswith("\u3000") for r in text)


def test_decoding_of_malformed_bytes(spark):
    cases = {"FEFF004100": "A", "EFBBBFFF41": "\ufffdA", "FFFE4100D8": "A", "FEFFD8000041": "\ufffdA", "FEFFD83DDE00": "😀", "FEFFDE00D83D": "\ufffd\ufffd", "": "", "FEFF": "", "C3A9": "é", "E9": "é", "C3": "Ã"}
    rows = spark.createDataFrame([(k, bytearray.fromhex(k)) for k in cases] + [("null", None)], "k string, raw binary")
    got = {r["k"]: r["t"] for r in rows.select("k", P.decode_text(F.col("raw")).alias("t")).collect()}
    assert got == cases | {"null": None}


def test_long_numbers_in_natural_order(spark):
    names = ["p" + "1" + "0" * 30 + ".png", "p9.png", "p" + "9" * 25 + ".png", "p010.png"]
    entries = spark.createDataFrame([("z", n) for n in names], "archive_id string, entry_name string")
    assert [r["entry_name"] for r in S.archive_pages(entries).orderBy("page_no").collect()] == [names[1], names[3], names[2], names[0]]


def test_shared_parts_of_a_tree(spark):
    """Sixteen diamonds in a row have 2 ** 16 paths; attributes come by the first."""
    rows = []
    for i in range(16):
        for j, k in enumerate("ab"):
            rows += [(1, f"{k}{i}", f"t{i}", j, "Pages", k, None, 90), (1, f"t{i + 1}", f"{k}{i}", 0, "Pages", None, None, None)]
    rows += [(1, "t0", None, 0, "Pages", "R", "M", None), (1, "p", "t16", 0, "Page", None, None, None), (1, "q", "b0", 5, "Page", None, "own", None)]
    got = H.flatten_page_tree(spark.createDataFrame(rows, "doc_id long, node string, parent string, ord int, type string, resources string, media_box string, rotate int")).orderBy("page_no").collect()
    assert [tuple(r)[1:] for r in got] == [("p", 0, "a", "M", 90), ("q", 1, "b", "own", 90)]


def test_wrapped_destinations(spark):
    chain = lambda n, start: [(1, start + i, "dict", None, start + i + 1) for i in range(n)] + [(1, start + n, "array", n, None)]
    objects = spark.createDataFrame([*chain(0, 100), *chain(7, 200), *chain(8, 300), (1, 400, "number", 5, None), (1, 500, "dict", None, None)], "doc_id long, num long, kind string, page_ref long, inner long")
    dests = spark.createDataFrame([(1, "dict", "a", 100), (1, "dict", "/b", 200), (1, "dict", "c", 300), (1, "tree", "c", 100), (1, "tree", "d", 400), (1, "tree", "e", 500), (1, "tree", "f", 9)], "doc_id long, origin string, name string, num long")
    entries = spark.createDataFrame([(1, "a", None, None, None), (1, None, "b", None, None), (1, None, None, "GoTo", "b"), (1, None, None, "Launch", "b"), (1, "c", None, None, None), (1, "d", None, None, None), (1, "e", None, None, None), (1, "f", None, None, None)], "doc_id long, dest_name string, array_name string, action string, action_name string")
    got = H.resolve_named_dest(H.dest_names(entries), H.unwrap_dests(dests, objects))
    assert sorted((r["dest_name"] or "", r["action"] or "", r["page_ref"]) for r in got.collect() if r["page_ref"] is not None) == [("a", "", 0), ("b", "", 7), ("b", "GoTo", 7)]
    assert got.count() == 8  # c is wrapped too often, and the tree isn't asked again


def test_page_tree_fallback_needs_a_scan(spark):
    pages = spark.createDataFrame([(1, 5, 0)], "doc_id long, num int, page_no int")
    objects = spark.createDataFrame([(d, n, "Page") for d in (1, 2, 3) for n in (9, 4)], "doc_id long, num int, type string")
    got = H.page_tree_fallback(pages, objects, spark.createDataFrame([(1,), (2,)], "doc_id long")).collect()
    assert sorted((r["doc_id"], r["num"], r["page_no"]) for r in got) == [(1, 5, 0), (2, 4, 0), (2, 9, 1)]


def test_pages_without_lines(spark):
    pages = spark.createDataFrame([(1, 0), (1, 1)], "doc_id long, page_no int")
    assert {r["page_no"]: r["text"] for r in L.page_text(spark.createDataFrame([(1, 1, 0, 0.0, 10.0, "x")], LINE), pages).collect()} == {0: "", 1: "x"}


def test_position(spark):
    m = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    r = spark.range(1).select(P.text_position(m(1, 0, 0, 1, 98.079, -225.309), m(1, 0, 0, 1, 72, 720)).alias("p"), P.compose(m(1, 0, 0, 1, 2, 3), m(2, 0, 0, 2, 1, 1)).alias("m")).first()
    assert (round(r["p"]["x"], 3), round(r["p"]["y"], 3)) == (170.079, 494.691)
    assert r["m"] == [2, 0, 0, 2, 5, 7]


def test_code_map(spark):
    ranges = spark.createDataFrame([(1, 2, "char", "0001", None, ["4E2D"]), (1, 1, "array", "0002", "0004", ["6587", "6D4B", "8BD5"])], "font_id long, seq int, kind string, lo string, hi string, dst array<string>")
    cmap = D.expand_ranges(ranges)
    strings = spark.createDataFrame([(1, 1, bytearray(b"\0\1\0\2\0\3\0\4")), (2, 1, bytearray())], "id long, font_id long, raw binary")
    none = spark.createDataFrame([], "font_id long, code long, uni string")
    got = {r["id"]: r["text"] for r in D.decode_codes(strings, spark.createDataFrame([(1, True)], "font_id long, composite boolean"), cmap, none).collect()}
    assert got == {1: "中文测试", 2: ""}


def test_differences(spark):
    base = spark.createDataFrame([(c, chr(c)) for c in range(32, 127)], "code int, uni string")
    diffs = spark.createDataFrame([(1, 0, 65, None), (1, 1, None, "endash"), (1, 2, None, "bullet"), (1, 3, None, "quotedbl"), (1, 4, None, "nosuch")], "font_id long, seq int, num int, glyph string")
    got = {r["code"]: r["uni"] for r in D.overlay_differences(base, diffs).collect()}
    assert (got[65], got[66], got[67], got[68]) == ("–", "•", '"', "D")
    assert len(D.glyphs()) > 200 and D.glyphs()["eacute"] == "é" and D.glyphs()["Zcaron"] == "Ž"


def test_legacy_cjk(spark):
    rows = spark.createDataFrame([(bytearray.fromhex("D6D0CEC4B7A2C6B1"), "gbk"), (bytearray.fromhex("4E2D6587"), "unicode"), (None, "gbk")], "raw binary, charset string")
    assert [r["t"] for r in D.decode_legacy_cjk(rows, "raw", "charset", "t").collect()] == ["中文发票", "中文", None]


def test_generations(spark):
    rows = [(1, 1, 3, 1, 10), (1, 1, 8, 1, 11), (1, 2, 3, 1, 5), (1, 2, 5, 1, 6), (1, 1, 9, 0, 0), (1, 2, 9, 1, 7)]
    got = {r["num"]: r["gen_order"] for r in H.merge_generations(spark.createDataFrame(rows, "doc_id long, gen_order int, num int, type int, offs long")).collect()}
    assert got == {3: 1, 8: 1, 5: 2, 9: 2}


def test_outline(spark):
    nodes = [(1, 21, 22, 24, "a", 0), (1, 22, None, 23, "b", 0), (1, 23, None, 22, "c", 0), (1, 24, 25, None, "d", 1), (1, 25, None, None, "e", 2)]
    got = H.flatten_outline(spark.createDataFrame(nodes, "doc_id long, num int, first int, next int, title string, page_no int"), spark.createDataFrame([(1, 21)], "doc_id long, first int")).orderBy("seq").collect()
    assert [(r["depth"], r["page_no"]) for r in got] == [(1, 0), (2, 0), (2, 0), (1, 1), (2, 2)]


def test_page_tree_inherits_and_ends(spark):
    nodes = [(1, "r", None, 0, "Pages", "F"), (1, "a", "r", 1, "Page", None), (1, "b", "r", 0, "Page", "G"), (1, "r", "a", 0, "Pages", None)]
    got = H.flatten_page_tree(spark.createDataFrame(nodes, "doc_id long, node string, parent string, ord int, type string, resources string")).orderBy("page_no").collect()
    assert [(r["node"], r["resources"]) for r in got] == [("b", "G"), ("a", "F")]


def test_markers(spark):
    docs = spark.createDataFrame([(1, "1 0 obj x 2 0 obj y\n1 0 obj z, a3 0 obj"), (2, None)], "doc_id long, text string")
    assert {r["num"]: r["pos"] for r in H.scan_markers(docs).collect()} == {1: 20, 2: 10}


def test_marks_and_chapters(spark):
    entry = "doc_id long, seq int, title string, page_no int"
    docs = spark.createDataFrame([(1, 3), (2, 45)], "doc_id long, n_pages int")
    outline = spark.createDataFrame([(1, 0, "a", 0), (1, 1, " ", 1), (1, 2, "x", 1), (1, 3, "c", 2), (2, 0, "only", 4)], entry)
    got = {(r["doc_id"], r["chap_no"]): (r["title"], r["start_page"], r["pages"]) for r in C.all_chapters(outline, docs).collect()}
    assert got == {(1, 1): ("a", 0, 1), (1, 2): ("第 2 节", 1, 1), (1, 3): ("c", 2, 1), (2, 1): ("第 1 节", 0, 20), (2, 2): ("第 2 节", 20, 20), (2, 3): ("第 3 节", 40, 5)}


def test_levels_and_downsampling(spark):
    outline = spark.createDataFrame([(1, i, "t", i, 1 if i < 19 else 2) for i in range(104)], "doc_id long, seq int, title string, page_no int, depth int")
    assert C.pick_level(outline).count() == 19
    marks = spark.createDataFrame([(1, i + 1) for i in range(205)], "doc_id long, mark_no int")
    assert C.downsample_marks(marks).count() == 40


def test_text_chapters(spark):
    def split(text):
        docs = spark.createDataFrame([(1, text.split("\n"))], "doc_id long, lines array<string>")
        return [r["title"] for r in C.split_text_chapters(docs).orderBy("chap_no").collect()]

    assert split("第一章 起点\nx\n第二章 中途\ny\n第三章 终点\nz") == ["第一章 起点", "第二章 中途", "第三章 终点"]
    assert split("1. 第一步\n2. 第二步") == ["正文"]


def test_markdown(spark):
    text = "# H\npara one\npara two\n> q\n- a\n* b\n1. c\n2) d\n```\n# code\n- x\n```\n---\n| a | b |\n|---|---|\n| c | d |"
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(text.split("\n"))], "doc_id long, line_no int, line string")
    got = T.md_blocks(lines).orderBy("block_no").collect()
    assert [r["type"] for r in got] == ["heading", "para", "quote", "item", "item", "item", "item", "code", "rule", "para", "para"]
    assert [r["marker"] for r in got if r["type"] == "item"] == ["•", "•", "1.", "2."]
    assert got[1]["lines"] == ["para one", "para two"] and got[7]["lines"] == ["# code", "- x"]


def test_inline(spark):
    runs = lambda s: [(r["t"], r["b"], r["i"], r["c"]) for r in spark.createDataFrame([(s,)], "s string").select(P.inline_runs(F.col("s")).alias("r")).first()["r"]]
    assert runs("a **b** *c* `d` ***e***") == [("a ", 0, 0, 0), ("b", 1, 0, 0), (" ", 0, 0, 0), ("c", 0, 1, 0), (" ", 0, 0, 0), ("d", 0, 0, 1), (" ", 0, 0, 0), ("e", 1, 1, 0)]
    assert "".join(r[0] for r in runs("[text](http://x) ![alt](y) \\* snake_case_name")) == "text ［图：alt］ * snake_case_name"
    assert all(r[2] == 0 for r in runs("snake_case_name"))


def test_figures(spark):
    items = spark.createDataFrame([(1, 1, i, 4, i % 3 == 2, f"n{i}") for i in range(2_000)], "doc_id long, chap_no int, seq int, n_lines int, figure boolean, name string")
    at, want = 0, []
    for i in range(2_000):
        at += 15 - at % 15 if i % 3 == 2 and 15 - at % 15 < 6 else 0
        want.append((i, f"n{i}", at))
        at += 6 if i % 3 == 2 else 4
    assert [(r["seq"], r["name"], r["line_pos"]) for r in C.place_figures(items, 6).orderBy("seq").collect()] == want


def test_pagination(spark):
    pages = (28, 52, 36, 44, 30, 48, 40, 42)
    got = C.paginate(spark.createDataFrame([(1, i, 15 * p) for i, p in enumerate(pages)], "doc_id long, chap_no int, n_lines int")).orderBy("chap_no")
    assert [r["start"] for r in got.collect()] == [0, 28, 80, 116, 160, 190, 238, 278]
    assert tuple(C.book_layout(got).first()) == (1, 320, 160, 4800)


def test_wrapping(spark):
    blocks = spark.createDataFrame([(1, 0, "para", "", "word " * 30 + "x" * 100), (1, 1, "item", "•", "中" * 50), (1, 2, "code", "", "")], "doc_id long, block_no int, type string, marker string, text string")
    got = C.wrap_lines(blocks, 20).collect()
    assert got and all(r["width"] <= 2000 for r in got) and {r["block_no"] for r in got} == {0, 1}
    item = sorted((r for r in got if r["block_no"] == 1), key=lambda r: r["pos"])
    assert len(item) == 3 and [r["marker"] for r in item] == ["•", None, None] and {r["pad"] for r in item} == {2}
    assert [r["pad"] for r in sorted(got, key=lambda r: r["pos"]) if r["block_no"] == 0][:2] == [2, 0]
    more = spark.createDataFrame([(2, 0, "heading", "", "二级标题", 2), (2, 1, "code", "", "const a = 1;", None), (2, 2, "para", "", "w " * 20_000, None)], "doc_id long, block_no int, type string, marker string, text string, level int")
    got = C.wrap_lines(more, 20).collect()
    assert {(r["style"], r["bold"], r["mono"]) for r in got} == {("h2", True, False), ("code", False, True), ("para", False, False)}
    assert sum(len(r["text"].split()) for r in got if r["block_no"] == 2) == 20_000  # many lines, none lost between the fold's parts


def test_sources(spark, tmp_path):
    for name, data in (("a.PDF", b"%PDF-1.4 aaaa"), ("b.md", b"x"), ("c.zip", b"12345678")):
        (tmp_path / name).write_bytes(data)
    files = S.route_format(S.scan_files(spark, str(tmp_path)))
    assert {r["ext"]: (r["fmt"], r["route"]) for r in files.collect()} == {"pdf": ("PDF", "pdf"), "md": ("MD", "text"), "zip": (None, "fallback")}
    assert {r["ext"]: r["reason"] for r in S.validate_header(files).collect()} == {"pdf": None, "md": "too short", "zip": "no PDF mark"}
    entries = spark.createDataFrame([("z", n) for n in ("p10.png", "P2.jpg", "p1.gif", "x.txt")] + [("y", "a.txt")], "archive_id string, entry_name string")
    assert [r["entry_name"] for r in S.archive_pages(entries).orderBy("page_no").collect()] == ["p1.gif", "P2.jpg", "p10.png"]
    assert [r["archive_id"] for r in S.empty_archives(entries).collect()] == ["y"]


def test_stats(spark):
    images = spark.createDataFrame([(1, 0, 1, 5, 4, "jpeg", ""), (1, 0, 2, 4, 5, "raw", ""), (1, 1, 3, 9, 9, "unsupported", "n2"), (1, 1, 4, 1, 1, "unsupported", "n2"), (1, 2, 5, 0, 9, "none", "")], "doc_id long, page_no int, img_seq int, width int, height int, kind string, note string")
    pages = spark.createDataFrame([(1, p) for p in range(4)], "doc_id long, page_no int")
    assert [r["img_seq"] for r in A.largest_image(images, pages).orderBy("page_no").collect()] == [1, 3, None, None]
    assert A.distinct_notes(images).first()["notes"] == ["n2"]
    assert A.image_summary(images).first()["usable"] == 2


def test_text_in_rows(spark):
    """Keywords, paragraphs and running sums within a row, of empty, null and long texts; nothing is shuffled."""
    docs = spark.createDataFrame([(1, "b b aaaa bbbb aaaa cccc " * 3), (2, ""), (3, None), (4, "x"), (5, "。".join("ab" * k for k in range(1, 60)))], "doc_id long, text string")
    words = A.keywords(docs, 2)
    assert [tuple(r) for r in words.where("doc_id < 5").orderBy("rank").collect()] == [(1, 1, "aaaa", 6), (1, 2, "bbbb", 3)]
    paras = C.chunk_headingless(docs, 100, 300)
    for made in (words, paras):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    own = paras.where("doc_id = 5").orderBy("para_no").collect()
    before = 0
    for r in own:
        assert r.chap_no == before // 300 + 1 and len(r.text) <= 100
        before += len(r.text)
    assert before == sum(2 * k for k in range(1, 60)) + 58 and [r.para_no for r in own] == list(range(len(own)))
    for n in (0, 1, 2, 3, 7, 8, 9, 100):
        values = list(range(n))
        got = spark.createDataFrame([(values,)], "v array<int>").select(C.running_sums(F.col("v")).alias("s")).first()["s"]
        assert got == [sum(values[: k + 1]) for k in range(n)]
