"""Small literal tables that Spark and SQL read alike."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

_SQL_TYPES = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


@dataclass(frozen=True)
class Fixture:
    name: str
    ddl: str
    rows: tuple

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), self.ddl)

    @property
    def sql(self) -> str:
        cols = [c.split() for c in self.ddl.split(", ")]

        def lit(v, t):
            if v is None:
                return f"NULL::{_SQL_TYPES[t]}"
            if isinstance(v, str):
                return "'" + v.replace("'", "''") + "'"
            return f"{v!r}::{_SQL_TYPES[t]}"

        body = ", ".join("(" + ", ".join(lit(v, t) for v, (_, t) in zip(row, cols)) + ")" for row in self.rows)
        return f"{self.name}({', '.join(c for c, _ in cols)}) AS (VALUES {body})"


SPANS = Fixture(
    "spans", "doc string, page int, line_no int, x0 double, y0 double, x1 double, y1 double, text string, size double, bold boolean",
    (
        ("d1", 0, 0, 72.0, 90.0, 400.0, 110.0, "Learning to Fold Maps", 20.0, True), ("d1", 0, 1, 72.0, 112.0, 420.0, 132.0, "in the Field", 20.0, True),
        ("d1", 0, 2, 72.0, 150.0, 300.0, 162.0, "Ann Bell, Carl Dorn", 11.0, False), ("d1", 0, 3, 72.0, 200.0, 140.0, 214.0, "Abstract", 12.0, True),
        ("d1", 0, 4, 72.0, 230.0, 540.0, 242.0, "We study how travellers fold maps when it rains and what they learn.", 10.0, False), ("d1", 0, 5, 72.0, 244.0, 540.0, 256.0, "The maps were folded by hand in three towns near the river and the sea.", 10.0, False),
        ("d1", 1, 0, 72.0, 40.0, 300.0, 52.0, "Folding Maps 12", 8.0, False), ("d1", 1, 1, 72.0, 100.0, 200.0, 116.0, "1 Introduction", 14.0, True),
        ("d1", 1, 2, 72.0, 140.0, 540.0, 152.0, "Maps have been folded for as long as they have been printed on paper.", 10.0, False), ("d1", 1, 3, 72.0, 170.0, 220.0, 184.0, "1.1 Early ", 11.5, True), ("d1", 1, 3, 220.0, 170.0, 300.0, 184.0, "folds", 11.5, False),
        ("d1", 1, 4, 72.0, 210.0, 540.0, 222.0, "A fold is a line along which the paper has been bent before it is opened.", 10.0, False), ("d1", 1, 5, 72.0, 260.0, 400.0, 272.0, "2. They walked on, and it rained all day.", 10.0, False),
        ("d1", 2, 0, 72.0, 41.0, 300.0, 53.0, "Folding Maps 13", 8.0, False), ("d1", 2, 1, 72.0, 100.0, 200.0, 116.0, "Results", 12.0, True), ("d1", 2, 2, 72.0, 140.0, 540.0, 152.0, "Every map that was folded twice could be read again after the rain.", 10.0, False),
        ("d1", 2, 3, 72.0, 300.0, 200.0, 312.0, "IV Discussion", 10.0, False), ("d1", 2, 4, 72.0, 360.0, 300.0, 372.0, "Contents ...... 14", 10.0, False),
        *(("d3", k, 0, 72.0, 30.0, 300.0, 40.0, "Deep  Survey", 8.0, False) for k in range(3)), *(("d3", k, 9, 280.0, 800.0, 295.0, 812.0, str(k + 1), 9.0, False) for k in range(3)),
        *(("d3", k, 2, 72.0, 120.0, 520.0, 132.0, "A long line of plain body text that fills the whole width of its page.", 10.0, False) for k in range(4)),
        ("d3", 3, 1, 72.0, 200.0, 300.0, 214.0, "Deep Survey", 14.0, True), ("d3", 3, 3, 72.0, 400.0, 300.0, 412.0, "Appendix A", 10.0, False), ("d3", 0, 3, 72.0, 770.0, 500.0, 782.0, "Unique line low on the page", 9.0, False),
        ("d4", 0, 0, 60.0, 100.0, 300.0, 120.0, "On Tides", 18.0, True), ("d4", 0, 1, 60.0, 60.0, 340.0, 75.0, "Permission to copy is granted", 20.0, False), ("d4", 0, 2, 60.0, 250.0, 300.0, 262.0, "Ida Holm", 11.0, False), ("d4", 0, 3, 60.0, 270.0, 300.0, 282.0, "Institute of Coasts, Paris", 10.0, False),
        ("d4", 0, 4, 20.0, 300.0, 32.0, 500.0, "arXiv:2501.1", 16.0, False), ("d4", 0, 5, 60.0, 580.0, 300.0, 590.0, "foot", 9.0, False),
        ("d2", 0, 0, 72.0, 100.0, 200.0, 118.0, "Short note", 18.0, False), ("d2", 0, 1, 72.0, 140.0, 300.0, 152.0, "No long line here.", 9.0, False), ("d2", 1, 0, 72.0, 40.0, 200.0, 52.0, "Once only", 9.0, False),
    ),
)
PAGE_SIZES = Fixture("page_sizes", "doc string, page int, width double, height double", (("d1", 0, 612.0, 792.0), ("d3", 0, 595.0, 842.0), ("d3", 1, 595.0, 842.0), ("d3", 2, 595.0, 842.0), ("d4", 0, 400.0, 600.0)))
OUTLINE = Fixture("outline", "doc string, pos int, level int, title string, page int", (("d1", 0, 1, "Introduction", 1), ("d1", 1, 2, "1.1 Early folds", 2), ("d1", 2, 1, "Results", 3), ("d1", 3, 3, "Discussion", 5)))
BLOCKS = Fixture(
    "blocks", "doc string, page int, block_no int, x0 double, y0 double, x1 double, y1 double, text string",
    (
        ("d1", 0, 0, 60.0, 50.0, 552.0, 80.0, "Full title"), ("d1", 0, 1, 60.0, 100.0, 296.0, 200.0, "Left one"), ("d1", 0, 2, 316.0, 95.0, 552.0, 190.0, "Right one"), ("d1", 0, 3, 60.0, 220.0, 296.0, 300.0, "Left two"),
        ("d1", 0, 4, 60.0, 320.0, 552.0, 350.0, "Full middle"), ("d1", 0, 5, 316.0, 360.0, 552.0, 420.0, "Right three"), ("d1", 0, 6, 60.0, 365.0, 296.0, 430.0, "Left three"),
        ("d1", 1, 0, 60.0, 300.0, 296.0, 320.0, "Second"), ("d1", 1, 1, 60.0, 100.0, 296.0, 120.0, "First"), ("d1", 1, 2, 20.0, 100.0, 40.0, 500.0, "arXiv stamp"), ("d1", 1, 3, 300.0, 760.0, 312.0, 772.0, "17"), ("d1", 0, 7, 60.0, 690.0, 300.0, 700.0, "Proceedings of a conference on maps"), ("d1", 1, 4, 60.0, 400.0, 300.0, 420.0, "<EOS> <pad> the"), ("d1", 1, 5, 60.0, 440.0, 300.0, 460.0, "Figure 3: <EOS> tokens"), ("d3", 1, 0, 72.0, 30.0, 300.0, 40.0, "Deep Survey"), ("d3", 3, 1, 72.0, 200.0, 300.0, 214.0, "Deep Survey"), ("d1", 1, 6, 60.0, 760.0, 300.0, 772.0, "2024"),
        ("d1", 2, 0, 60.0, 100.0, 300.0, 200.0, "in the table"), ("d1", 2, 1, 60.0, 190.0, 300.0, 290.0, "barely touching"), ("d1", 2, 2, 60.0, 400.0, 300.0, 420.0, "in the figure"), ("d1", 2, 3, 60.0, 600.0, 300.0, 620.0, "free"),
    ),
)
BLOCK_LINES = Fixture(
    "blines", "doc string, page int, block_no int, y0 double, x0 double, y1 double, x1 double, text string",
    (("d1", 0, 0, 100.0, 60.0, 110.0, 290.0, "left a"), ("d1", 0, 0, 100.0, 320.0, 110.0, 550.0, "right a"), ("d1", 0, 0, 112.0, 60.0, 122.0, 290.0, "left b"), ("d1", 0, 1, 200.0, 60.0, 210.0, 290.0, "left"), ("d1", 0, 1, 212.0, 60.0, 222.0, 400.0, "wide"), ("d1", 0, 1, 224.0, 320.0, 234.0, 550.0, "right"), ("d1", 1, 2, 50.0, 320.0, 60.0, 500.0, "only right")),
)
REGIONS = Fixture("regions", "doc string, page int, kind string, x0 double, y0 double, x1 double, y1 double", (("d1", 2, "table", 50.0, 90.0, 310.0, 205.0), ("d1", 2, "figure", 50.0, 410.0, 310.0, 500.0)))
CAPTIONS = Fixture("captions", "doc string, page int, caption_no int, y0 double", (("d1", 0, 1, 300.0), ("d1", 0, 2, 700.0), ("d1", 1, 3, 120.0), ("d1", 1, 4, 400.0)))
IMAGES = Fixture("images", "doc string, page int, image_no int, y1 double", (("d1", 0, 1, 280.0), ("d1", 0, 2, 650.0), ("d1", 0, 3, 140.0), ("d1", 1, 4, 390.0)))
TABLES = Fixture("tables_", "doc string, page int, table_no int, y0 double", (("d1", 0, 7, 320.0), ("d1", 0, 8, 90.0), ("d1", 1, 9, 130.0)))
RULES = Fixture("rules", "doc string, page int, caption_no int, x0 double, y0 double, x1 double, y1 double", (("d1", 0, 1, 70.0, 310.0, 300.0, 311.0), ("d1", 0, 1, 60.0, 340.0, 320.0, 341.0), ("d1", 0, 1, 70.0, 380.0, 300.0, 381.0), ("d1", 0, 1, 70.0, 460.0, 300.0, 461.0), ("d1", 0, 1, 70.0, 470.0, 300.0, 471.0)))
AUTHORS = Fixture("names_", "doc string, pos int, name string", tuple(("d1", i, n) for i, n in enumerate(["Ann Bell", "Carl Dorn", "Ann Bell", "Eva F. Gray", "university of maps", "Hal Ivers", "Jo Kern", "Lia Moss", "Nia Orr"])) + (("d2", 0, "Solo Author"), ("d2", 1, "Second Author")))
TOC = Fixture(
    "toc", "doc_id string, toc_pos int, parent_pos int, depth int, title string, path string, fragment string",
    (
        ("b1", 0, None, 0, "Foreword", "text/fore.xhtml", ""), ("b1", 1, None, 0, "Part I", "text/ch1.xhtml", ""), ("b1", 2, 1, 1, "Chapter 1", "text/ch1.xhtml", ""), ("b1", 3, 1, 1, "Chapter 2", "text/ch2.xhtml", "mid"),
        ("b1", 4, None, 0, "Notes", "notes.xhtml", ""), ("b1", 5, None, 0, "Again", "text/fore.xhtml", ""), ("b1", 6, None, 0, "Lost", "missing.xhtml", ""), ("b1", 9, None, 0, "Dotted", "back/../text/./ch3.xhtml", ""), ("b1", 7, None, 0, "Kept group", "text/ch3.xhtml", ""), ("b1", 8, 7, 1, "Inside", "text/ch3.xhtml", "x"),
        ("b2", 0, None, 0, "Book", "", ""), ("b2", 1, 0, 1, "Phần 1", ".", ""), ("b2", 2, 1, 2, "Deep", "a.xhtml", "z"),
    ),
)
SPINE = Fixture(
    "spine", "doc_id string, spine_pos int, path string, linear string, is_nav boolean",
    (
        ("b1", 0, "OEBPS/nav.xhtml", "yes", True), ("b1", 1, "text/fore.xhtml", "yes", False), ("b1", 2, "text/ch1.xhtml", None, False), ("b1", 3, "text/ch2.xhtml", "yes", None), ("b1", 4, None, "yes", False),
        ("b1", 5, "text/ch3.xhtml", "yes", False), ("b1", 6, "back/notes.xhtml", "yes", False), ("b1", 7, "text/ad.xhtml", "no", False), ("b2", 0, "a.xhtml", "yes", False),
    ),
)
ELEMENTS = Fixture(
    "elements", "doc_id string, path string, el_pos int, anchor string, text string",
    (
        ("b1", "text/fore.xhtml", 0, None, "Foreword"), ("b1", "text/fore.xhtml", 1, None, "Dear reader"), ("b1", "text/ch1.xhtml", 0, None, "Chapter 1"), ("b1", "text/ch1.xhtml", 1, None, "It began"),
        ("b1", "text/ch2.xhtml", 0, None, "tail of one"), ("b1", "text/ch2.xhtml", 1, "mid", ""), ("b1", "text/ch2.xhtml", 2, None, "Chapter 2"), ("b1", "text/ch2.xhtml", 3, None, "It went on"),
        ("b1", "text/ch3.xhtml", 0, None, "Chapter 3"), ("b1", "back/notes.xhtml", 0, None, "Note"), ("b2", "a.xhtml", 0, None, "before"), ("b2", "a.xhtml", 1, "z", "Deep"), ("b2", "a.xhtml", 2, None, "deeper"),
    ),
)
HREFS = Fixture("hrefs", "href string", (("text/./a.xhtml#p1",), ("text/../img/b.png",), ("..\\c%20d.xhtml",), ("e.xhtml",), ("#only",), ("x/y/../../z.xhtml#q",), ("B%C3%BCcher/a%2Bb+c.xhtml#s%20t",), ("../up.xhtml",), ("a%23b.xhtml",)))
TEXTBOOK = Fixture(
    "textbook", "doc string, pos int, line string",
    tuple(("t1", i, s) for i, s in enumerate(["Chương 1", "Mở đầu về bản đồ", "A. Mục tiêu", "Người học hiểu bản đồ và", "biết cách gấp.", "", "I- Khái niệm", "1. Bản đồ là gì", "Bản đồ là hình vẽ thu-", "nhỏ của mặt đất.", "> Lời trích", "## B. Nội dung", "", "Kết luận", "Hết bài."])),
)
DOCX = Fixture("docx", "doc string, pos int, style string, text string", (("w1", 0, "heading 1", "Beginnings"), ("w1", 1, "normal", "Text one"), ("w1", 2, "heading 2", "Inner"), ("w1", 3, "normal", "Chapter 2 of his life"), ("w1", 4, "heading 1", "Ends"), ("w2", 0, "normal", "Chapter One"), ("w2", 1, "normal", "Words"), ("w2", 2, "normal", "Chapter two: The road"), ("w2", 3, "normal", "Part of him wanted to stay"), ("w2", 4, "title", "Late title")))
NUMBER_LINES = Fixture("nlines", "doc string, block int, pos int, line string", (("n1", 0, 0, "2"), ("n1", 0, 1, "Methods"), ("n1", 0, 2, "We walked."), ("n1", 1, 0, "3.1"), ("n1", 1, 1, "the small part"), ("n1", 2, 0, "17"), ("n1", 3, 0, "4"), ("n1", 3, 1, "Results and more")))
REPLIES = Fixture("replies", "chunk_id string, reply string", (("c1", "[[[P_a]]]\nMột\n\n[[[P_b]]]\nHai"), ("c2", "[[[P_a]]] Một"), ("c3", "Một\n\nHai"), ("c4", "Một\n\nHai\n\nBa"), ("c5", "[[[P_a]]]\nMột\n[[[P_a]]]\nMột mới\n[[[P_b]]]\n  "), ("c6", "[[[P_x]]]\nLạ\n\n[[[P_a]]]\nMột"), ("c7", "")))
EXPECTED = Fixture("expected", "chunk_id string, para_id string, pos int", tuple((f"c{i}", p, k) for i in range(1, 8) for k, p in enumerate("ab")))
CHARACTERS = Fixture("characters", "project_id string, pos int, name string, gender string, role string, first string, second string, third string, notes string", (("p1", 0, "Anna ", "female", "hero", "tôi", "cậu", "cô ấy", ""), ("p1", 1, "Bob", "male", "", "tớ", "cậu", "anh ấy", "gruff"), ("p1", 2, "ANNA", "female", "queen", "ta", "ngươi", "bà ấy", "older"), ("p2", 0, "Cy", "male", "", "tôi", "cậu", "cậu ấy", "")))
TERMS = Fixture("terms", "project_id string, pos int, source string, target string, description string", (("p1", 0, "map", "bản đồ", ""), ("p1", 1, "Map", "tấm bản đồ", "paper"), ("p1", 2, "", "trống", ""), ("p1", 3, "fold", "", ""), ("p3", 0, "sea", "biển", "")))
FORMS = Fixture("forms", "text string", (("friend - tớ / cậu",), ("king",), ("chú - chú, cháu, ông",), ("",), ("aunt – cô",)))
STYLES = Fixture("styles", "project_id string, document_type string, source_format string, tone string", (("s1", "paper", "pdf", "novel"), ("s2", "novel", "epub", "academic"), ("s3", "textbook", "pdf", "academic"), ("s4", "", "pdf", "fantasy"), ("s5", "", "txt", "strange"), ("s6", "novel", "docx", "classic")))
EXPORTS = Fixture("exports", "format string, source_format string, has_source boolean", (("epub", "epub", True), ("epub_bilingual", "pdf", True), ("docx", "epub", False), ("html", "txt", True), ("pdf_bilingual", "txt", True), ("txt", "md", True), ("rtf", "md", True), ("epub", "epub", False)))
UPLOADS = Fixture("uploads", "file_name string, n_bytes long, document_type string", (("a.epub", 10, "novel"), ("b.pdf", 10, "paper"), ("c.pdf", 10, "novel"), ("d.txt", 0, "novel"), ("e.md", 104857601, "novel"), ("f.exe", 5, "novel"), ("g.docx", 5, "textbook"), ("../h.txt", 5, "novel"), ("i.txt", 5, ""), ("j.PDF", 5, "")))
FILES = Fixture("files", "name string", (("1a2b3c4d_the_long_road.epub",), ("Atlas_of_Rain.pdf",), ("plain.txt",), ("deadbeef_Ü.md",), ("no_ext",)))
PROVIDERS = Fixture("calls", "call_id int, provider string, model string, message string, retry_header string", ((1, "gemini", "", "429 quota exceeded per day", None), (2, "gemini", "flash", "429: retry in 12 s", None), (3, "openai", "", "rate limit", "20"), (4, "openai", "gpt", "timeout", None), (5, "free", "x", "", None), (6, "gemini", "", "RESOURCE_EXHAUSTED", None), (7, "gemini", "gemini-1.5-pro", "Quota exceeded: GenerateRequestsPerDay", "9"), (8, "gemini", "gemini-3.7-flash", "please retry in 12.7 s", None), (9, "deepseek", "", "per_day limit", "x")))
KEYS = Fixture("keys_", "account string, keys string", (("a", "k1;k2, k3\r\nk4"), ("b", " ; ,"), ("c", "abcdefghijkl")))
PROBES = Fixture("probes", "account string, outcome string", (("a", "ok"), ("a", "daily"), ("b", "daily"), ("b", "rpm"), ("c", "rpm"), ("d", "error"), ("d", "ok"), ("e", "other"), ("f", "invalid"), ("f", "error"), ("g", "invalid"), ("g", "rpm")))
HTML = Fixture(
    "html", "page_id int, html string",
    (
        (1, "<html><head><title>T</title><style>p{}</style></head><body><nav><a href='#'>Home</a></nav><h1>The <b>Long</b> Road</h1><p>One<br>two &amp; three</p><div>loose <i>text</i><p>inner</p>tail</div><hr/><ul><li>a</li><li><p>b</p></li></ul></body></html>"),
        (2, "<body><p>first<p>second <b>bold</p><blockquote>quoted<div>deep</div></blockquote><p></p><p>* * *</p><h2>Next</h2><p>end</body>"),
    ),
)
FORMULAS = Fixture("formulas_", "row_no int, text string", ((1, "Let $a<b$ and $$\\frac{a}{b}$$ hold, so $a<b$."), (2, "no formula costs 5$"), (3, None), (4, "$x$ then $x$y$ & $ab$")))
ASSETS = Fixture("assets", "doc_id string, pos int, name string, is_image boolean", (("b1", 0, "style.css", False), ("b1", 1, "images/p1.jpg", True), ("b1", 2, "images/Front.png", True), ("b1", 3, "cover.jpg", True), ("b2", 0, "cover.xhtml", False), ("b2", 1, "a.gif", True)))
MEMBERS = Fixture("members", "doc_id string, member string", (("b1", "OEBPS/text/ch1.xhtml"), ("b1", "ch1.xhtml"), ("b1", "OEBPS/xch1.xhtml"), ("b1", "a/b/text/ch1.xhtml"), ("b2", "text/ch1.xhtml")))
DOCS = Fixture("docs", "doc_id string, name string", (("b1", "text/ch1.xhtml"), ("b1", "ch1.xhtml"), ("b2", "ch2.xhtml")))
ASKED = Fixture("asked", "doc string, page int, ask_no int, text string, x0 double, y0 double", (("d1", 0, 0, "ABSTRACT ", None, None), ("d1", 0, 1, "fold maps", 72.0, 95.0), ("d1", 1, 2, "1.1  Early folds", None, None), ("d1", 2, 3, "not there at all", None, None), ("d3", 3, 4, "Deep Survey of all", 72.0, 200.0), ("d1", 0, 5, "maps", 72.0, 250.0)))
RULED = Fixture("ruled", "doc string, page int, x0 double, y0 double, x1 double, y1 double", (("d1", 0, 50.0, 100.0, 300.0, 200.0), ("d1", 2, 50.0, 90.0, 310.0, 205.0)))
CAPTIONED = Fixture("captioned", "doc string, page int, x0 double, y0 double, x1 double, y1 double", (("d1", 0, 60.0, 150.0, 280.0, 250.0), ("d1", 0, 60.0, 400.0, 280.0, 450.0), ("d1", 1, 50.0, 100.0, 300.0, 200.0)))
METADATA = Fixture(
    "metadata", "file_name string, title string, author string",
    (("GIÁO TRÌNH TRIẾT HỌC (K-2021)", "", ""), ("giao trinh lich su", None, None), ("Maps of Rain", "Untitled-1", "admin"), ("x", "On Tides ", " Ida Holm"), ("ATLAS OF SEAS", " ", "Li"), ("y", "Map", "LaTeX user"), ("z", "Texture of Maps", "Bo Ek")),
)
STORES = Fixture(
    "stores", "project_id string, store string",
    (
        ("p1", '{"tone": "classic", "custom_instructions": "keep names", "characters": [{"name": "Anna", "gender": "female", "role": "hero", "first_person": "em", "second_person": "anh", "third_person": "cô ấy", "notes": "quiet"}, {"name": "Bob"}], "terms": [{"source_term": "map", "target_term": "bản đồ"}]}'),
        ("p2", "{}"), ("p3", "not json"), ("p4", None), ("p5", '{"characters": [], "terms": [{"source_term": "sea", "target_term": "biển", "category": "place", "description": "wide"}]}'),
    ),
)
ASKED_NAMES = Fixture("asked_names", "project_id string, name string", (("p1", " anna"), ("p1", "BOB"), ("p1", "Carl"), ("p2", "Anna"), ("p1", None)))
