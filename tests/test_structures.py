"""Style rules, robots rules, rule sets, page structure, bands, page files and streams against plain versions."""

import os
import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from weftline.functions import urls
from weftline.operators import capture, design, report
from weftline.plans.page_files import PageFiles
from weftline.sources import web
from weftline.streaming import recorder


def test_style_rules(spark):
    css = """/* x{y:z} */ @charset "a;b"; :root{--a: 1px;--b:url(data:x;y{z)} .q::after{content:"}\\"{";color:RED}
    @media screen and (min-width:9px){ .a{ top:0; &:hover{left:1px} bottom:2px } @keyframes spin{from{a:b}50%{c:d}} }
    @font-face{font-family:A;src:url(x.woff2)} @-webkit-keyframes k{to{e:f}} } .late{g:h;i:j"""
    sheets = spark.createDataFrame([("p", 0, css), ("p", 1, None), ("p", 2, ""), ("q", 0, "no rule; at all"), ("q", 1, "a{b:c}}} d{e:f}")], "page string, sheet int, css string")
    rows = capture.css_rules(sheets).collect()
    got = [(r.ord, r.type, r.selector, r.condition, list(r.media), [tuple(d) for d in r.declarations]) for r in sorted(rows, key=lambda r: r.ord) if r.page == "p"]
    assert got == [
        (1, "style", ":root", None, [], [("--a", "1px"), ("--b", "url(data:x;y{z)")]),
        (2, "style", ".q::after", None, [], [("content", '"}\\"{"'), ("color", "RED")]),
        (3, "media", None, "screen and (min-width:9px)", [], []),
        (4, "style", ".a", None, ["screen and (min-width:9px)"], [("top", "0"), ("bottom", "2px")]),
        (5, "style", "&:hover", None, ["screen and (min-width:9px)"], [("left", "1px")]),
        (6, "keyframes", "spin", None, ["screen and (min-width:9px)"], []),
        (7, "font-face", None, None, [], [("font-family", "A"), ("src", "url(x.woff2)")]),
        (8, "keyframes", "k", None, [], []),
        (9, "style", ".late", None, [], [("g", "h"), ("i", "j")]),
    ]
    text = {r.ord: r.css_text for r in rows if r.page == "p"}
    assert text[4] == ".a{ top:0; &:hover{left:1px} bottom:2px }" and text[6] == "@keyframes spin{from{a:b}50%{c:d}}" and text[9] == ".late{g:h;i:j"
    assert [(r.selector, r.css_text) for r in sorted(rows, key=lambda r: r.ord) if r.page == "q"] == [("a", "a{b:c}"), ("d", "d{e:f}")]
    rules = capture.css_rules(sheets)
    assert {r.name for r in capture.root_properties(rules).collect()} == {"--a", "--b"} and capture.conditions(rules).first().condition == "screen and (min-width:9px)" and capture.font_faces(rules).first().family == "A"
    assert capture.css_rules(sheets.limit(0)).collect() == []


def test_robots_against_patterns(spark):
    r = random.Random(3)
    word = lambda n: "".join(r.choice("ab/*?$.") for _ in range(n))
    rules = [(r.choice(["https://a.example", "https://b.example"]), r.choice(["/", ""]) + word(r.randint(1, 6))) for _ in range(40)] + [("https://a.example", "*b.b"), ("https://c.example", "/")]
    pages = [(k, f"{r.choice(['https://a.example', 'https://b.example', 'https://c.example', 'https://d.example'])}/{word(r.randint(0, 9)).replace('*', 'c')}#x") for k in range(300)] + [(400, None), (1, "https://a.example/")]
    got = {(x.i, x.url): x.robots for x in web.robots_blocked(spark.createDataFrame(pages, "i int, url string"), spark.createDataFrame(rules, "origin string, rule string")).collect()}
    for i, url in pages:
        origin, _, rest = (url or "").partition(".example")
        path, _, query = rest.partition("#")[0].partition("?")
        tail = path + (f"?{query}" if query else "")
        assert got[i, url] == (url is not None and any(o == f"{origin}.example" and re.match(re.escape(p).replace(r"\*", ".*"), tail) for o, p in rules)), url


def test_what_patterns_require():
    assert design.required(r"color: red") == "color: red" and design.required(r"(?i)Lorem\s+IPSUM x") == "ipsum x" and design.required(r"ab(cde|xyzw)f") == "ab" and design.required(r"(?:abcd)?xy") == "xy"
    assert design.required(r"(abc)+d") == "abc" and design.required(r"a*bc{2}") in ("b", "c") and design.required(r"x{0,3}") == "" and design.required(r"(?U)\bfoo") in ("", "foo") and design.required("[") == ""
    assert design.required(r"(?:(?i:ab)cd)") in ("", "cd") and design.required("straße") == "stra"


def test_rule_sets_against_plain_search(spark):
    r = random.Random(9)
    texts = [(k, "".join(r.choice(["ab", "AB", "cde", " ", "red", "Red;", "é", "x"]) for _ in range(r.randint(0, 30)))) for k in range(200)] + [(500, None), (501, ""), (1, "red")]
    rules = [(p, f"m{k}") for k, p in enumerate(["red", "(?i)RED;", "ab(?:cde|x)", "[xé]{2}", "^$", "(?:cde)+ ", "a?b$", "zzz", "éx+red", "red"])]
    lines = spark.createDataFrame(texts, "i int, body string")
    got = design.line_hits(lines, spark.createDataFrame(rules, "pattern string, message string"))
    want = [(i, t, p, m) for i, t in texts if t is not None for p, m in rules if re.search(p, t)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert design.line_hits(lines, spark.createDataFrame([], "pattern string, message string")).collect() == []


class Paths(HTMLParser):
    """The same paths by the library's own parser."""

    def __init__(self):
        super().__init__()
        self.stack, self.found = [], set()

    def leave(self, tag):
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass

    def handle_starttag(self, tag, attrs):
        if tag in capture.SELF_CLOSING:
            self.leave(tag)
        self.found.add(" > ".join([*self.stack, tag]))
        if tag not in capture.VOID:
            self.stack.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.leave(tag)


def test_tag_paths_against_a_parser():
    r = random.Random(2)
    pieces = ["<p>", "</p>", "<b>", "</b>", "<br>", "<ul>", "<li>", "</ul>", '<a href="x>y">', "</a>", "<!-- <i> -->", "<script>var t = '<u>';</script>", "<style>p{}</style>", "text", "<IMG src=x>", "<div class='a'>", "</div>", "<input/>", "</x>"]
    for _ in range(300):
        html = "".join(r.choice(pieces) for _ in range(r.randint(0, 25)))
        p = Paths()
        p.feed(html)
        p.close()
        assert capture.tag_paths(html) == sorted(p.found), html


def test_templates_by_structure(spark):
    pages = [(1, "<html><body><p><b>x</b></p></body></html>"), (2, "<html><body><p>x<br></p></body></html>"), (3, "<main><div>x</div></main>"), (4, None), (5, "")]
    got = capture.templates(capture.by_structure(spark.createDataFrame(pages, "page int, html string"))).collect()
    assert sorted((r.instances, list(r.fixed), list(r.varying)) for r in got) == [(1, ["main", "main > div"], []), (2, ["html", "html > body", "html > body > p"], ["html > body > p > b", "html > body > p > br"])]


def test_bands(spark):
    pairs = spark.createDataFrame([(1, [0, 10, 255, 0], [0, 27, 0, 0]), (2, [5, 5], [5, 5, 5, 5]), (3, [], None)], "i int, a array<int>, b array<int>")
    got = {(r.i, r.band): (r.similarity_pct, r.within16_pct, r.max_delta) for r in report.band_scores(pairs, "a", "b", {"top": (0, 2), "low": (2, 4), "none": (9, 12)}).collect()}
    assert got[1, "top"] == (100 - 17 / 2 / 255 * 100, 50.0, 17) and got[1, "low"] == (50.0, 50.0, 255) and got[1, "none"] == (None, None, None) and got[2, "top"] == (100.0, 100.0, 0) and got[2, "low"] == (0.0, 0.0, 255)


def test_pages_appear_together_or_not_at_all(spark, tmp_path):
    spark.dataSource.register(PageFiles)
    pages = spark.createDataFrame([(f"{k}.html", f"<p>é\r\n{k}</p>", 1) for k in range(40)], "slug string, html string, extra int").repartition(7)
    path = str(tmp_path / "site")
    pages.write.format("page_files").mode("append").save(path)
    assert len(os.listdir(path)) == 40 and open(f"{path}/7.html", encoding="utf-8", newline="").read() == "<p>é\r\n7</p>" and os.listdir(tmp_path) == ["site"]
    for bad in (("x.html", None, 1), ("a/b.html", "t", 1), (None, "t", 1), ("..", "t", 1)):
        with pytest.raises(Exception, match="page|named"):
            pages.unionByName(spark.createDataFrame([bad], pages.schema)).write.format("page_files").mode("overwrite").save(path)
        assert len(os.listdir(path)) == 40 and os.listdir(tmp_path) == ["site"]
    with pytest.raises(Exception, match="already"):
        pages.write.format("page_files").mode("append").save(path)
    pages.limit(3).write.format("page_files").mode("overwrite").save(path)
    assert len(os.listdir(path)) == 3 and os.listdir(tmp_path) == ["site"]


def replayed(spark, tmp_path, batches, make, schema):
    """Rows that a stream gives out, and how many it holds in the end; one micro-batch for each list of rows."""
    where = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(where)
    stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(where)
    name = f"t{random.randrange(10**9)}"
    q = recorder.replay(make(stream), name, str(tmp_path / "log"))
    last = q.recentProgress[-1]
    return [tuple(r) for r in spark.table(name).collect()], sum(o.numRowsTotal for o in last.stateOperators)


def test_visits_end_and_their_state_goes(spark, tmp_path):
    at = lambda s: __import__("datetime").datetime(2026, 1, 1, 0, 0) + __import__("datetime").timedelta(seconds=s)
    batches = [[(1, 5, at(0)), (1, 3, at(50)), (2, 9, at(10))], [(1, 1, at(400)), (1, 2, at(120))], [(3, 1, at(5000))], [(3, 2, at(5001))], [(1, 0, at(60)), (3, 0, at(5010))], [(4, 0, at(90_000))], [(4, 1, at(90_001))]]
    make = lambda s: recorder.first_of_visit(s.withColumn("o", F.col("seq")), ["k"], "seq", "o", "ts", "100 seconds", "300 seconds")
    got, held = replayed(spark, tmp_path, batches, make, "k int, seq int, ts timestamp")
    # key 1: 0 to 120 is one visit, 400 another; the record of second 60 comes when the first has been given out, and is dropped
    assert sorted((k, seq, n) for k, _, _, seq, n in got) == [(1, 1, 1), (1, 2, 3), (2, 9, 1), (3, 0, 3)] and held == 1


def test_starts_without_an_end_come_out(spark, tmp_path):
    at = lambda s: __import__("datetime").datetime(2026, 1, 1, 0, 0) + __import__("datetime").timedelta(seconds=s)
    batches = [[("run", 1, at(0)), ("run", 2, at(5))], [("end", 1, at(30)), ("run", 1, at(40))], [("end", 1, at(99)), ("end", 3, at(50))], [("run", 9, at(9000)), ("end", 9, at(9000))], [("run", 8, at(9001)), ("end", 8, at(9001))]]

    def make(s):
        starts, ends = s.where("kind = 'run'").select("k", "ts"), s.where("kind = 'end'").select("k", "ts", F.lit("x").alias("to"))
        return recorder.with_ends(starts, ends, ["k"], "60 seconds", "100 seconds").select("k", F.unix_timestamp("ts") % 10_000, F.col("e_to"))

    got, held = replayed(spark, tmp_path, batches, make, "kind string, k int, ts timestamp")
    mine = sorted((k, to) for k, _, to in got if k < 8)
    assert mine == [(1, "x"), (1, "x"), (2, None)] and held <= 4


def test_urls_of_null(spark):
    assert spark.createDataFrame([(None, "a")], "b string, r string").select(urls.resolved(F.col("b"), F.col("r")).alias("u")).first().u is None
