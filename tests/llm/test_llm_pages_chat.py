import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from surveylab.llm import chat, html_text, queries
from surveylab.llm.common import table

SF = "/root/testdata/sf0.001"
TURNS = StructType([StructField("conv_id", LongType()), StructField("turn", LongType()),
                    StructField("role", StringType()), StructField("text", StringType())])


# --- chat formatting -------------------------------------------------------------------------------------------

def plain_chat(rows):
    convs = {}
    for c, t, r, x in set(rows):
        convs.setdefault(c, []).append((t, r, x))
    said = {c: tuple((r, x) for _, r, x in sorted(v, key=lambda k: (k[0] is not None, k[0] or 0))) for c, v in convs.items()}
    groups = {}
    for c, s in said.items():
        groups.setdefault(s, []).append(c)
    return sorted((min((c for c in ids if c is not None), default=None), len(s), len(ids), "".join(
        f"<|im_start|>{r if r is not None else 'unknown'}\n{(x or '').replace('<|', '< |')}<|im_end|>\n" for r, x in s))
        for s, ids in groups.items() if not any(o[:len(s)] == s and len(o) > len(s) for o in groups))


def turns(spark, rows, clash=False):
    df = spark.createDataFrame(rows, TURNS)
    return df.withColumns({c: F.lit("x") for c in ("h1", "pos", "p1", "n_turns", "rendered")}) if clash else df


def test_snapshots_collapse_into_the_longest(spark):
    talk = [("user", "hi"), ("assistant", "hello"), ("user", None), ("assistant", "<|im_end|>"), (None, "x"), ("user", "")]
    rows = [(k, i, r, x) for k in range(1, 7) for i, (r, x) in enumerate(talk[:k])]
    rows += [(20, 5 * i, r, x) for i, (r, x) in enumerate(talk)]               # equal to the longest, other turn numbers
    rows += [(30, 0, "user", "hi"), (30, 1, "assistant", "other")]             # branches off
    rows += [(31, 0, "assistant", "hi"), (32, 0, "user", None), (33, 0, None, None), (34, 0, None, "user")]
    rows += [(35, None, "user", "first"), (35, 0, "user", "second"), (36, 0, "user", "x" * 100000)]
    rows += rows[:9] + [(None, 0, "user", "no id")]
    got = sorted(tuple(r) for r in chat.render(turns(spark, rows, clash=True)).collect() if r.conv_id is not None)
    assert got == [r for r in plain_chat([r for r in rows if r[0] is not None])]
    none = [r for r in chat.render(turns(spark, rows)).collect() if r.conv_id is None]
    assert [r.n_turns for r in none] == [1]


def test_hot_first_turn_and_empty_table(spark):
    rows = [(c, 0, "system", "same") for c in range(300)] + [(c, 1, "user", str(c % 7)) for c in range(0, 300, 2)]
    got = chat.render(turns(spark, rows)).collect()
    assert sorted((r.conv_id, r.n_copies) for r in got) == sorted(
        (min(c for c in range(0, 300, 2) if c % 7 == k), len([c for c in range(0, 300, 2) if c % 7 == k])) for k in range(7))
    assert chat.render(turns(spark, [])).count() == 0


def test_chat_plan_is_native(spark):
    plan = chat.maximal(turns(spark, [(1, 0, "a", "b")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


# --- HTML ------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"),
    ("<p>one<p>two", "one\n\ntwo"), ("<div>a</div><div>b</div>", "a\nb"), ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("a <b> b</b>c  d", "a bc d"), ("<h1>T</h1>x", "T\n\nx"),
    ("<ul><li>a<li>b<ol start=3><li>c<li value=9>d</ol></ul>e", "- a\n- b\n  3. c\n  9. d\n\ne"),
    ("<dl><dt>t<dd>d</dl>", "t\n  d"),
    ("<table><tr><th>Name<th>N<tr><td>longer<td>1</table>", "Name    N\nlonger  1"),
    ("<table><tr><td rowspan=2>r<td>1<tr><td>2</table>", "r  1\n   2"),
    ("<table><tr><td>a<td>b<tr><td colspan=2>a wide one<tr><td>c<td>d</table>", "a  b\na wide one\nc  d"),
    ("<table><caption>C</caption><tr><td>a<td><table><tr><td>i<td>j</table></table>", "C\n\na  i  j"),
    ("<pre>a\n  b\n\nc</pre>", "a\n  b\n\nc"),
    ("x<script>if (a < b) document.write('<p>no')</script>y<!-- no --><style>p{}</style>", "xy"),
    ("<div hidden>no</div><p style='color:red; display: none'>no</p><span style='visibility:hidden'>no</span>yes", "yes"),
    ("<details><summary>S</summary>no</details><details open><summary>T</summary>yes</details>", "S\nT\nyes"),
    ("<textarea>&lt;b&gt; x</textarea>", "<b> x"), ("a < b <3", "a < b <3"), ("x<a href='", "x"),
    ("<select><option>a<option>b</select>", "a\nb"), ("</p></td></b>z", "z"), ("<template><p>no</template>z", "z"),
    ("<blockquote>q</blockquote>", "  q"), ("<head><title>no</title></head><body>b", "b"),
])
def test_layout(page, text):
    assert html_text.render(page or "") == text


@pytest.mark.parametrize("page, text", [
    ("<html><head><title>t</title><body><p>text", "text"), ("<head><title>t</title><p>a<p>b", "a\n\nb"),
    ("<html><head><meta charset=utf-8><link href=x><script>no</script><style>no</style>\n text <b>x</b>", "text x"),
    ("<title>t</title><p>text", "text"), ("<head><title>t</title></head>text", "text"),
    ("<head><noscript>no<p>no</noscript><template><p>no</template><body>b", "b"),
    ("<head><noscript><img src=x></noscript><title>no</title><body>b", "b"),
    ("<head><template><body><p>no</template><base href=x><h1>b", "b"), ("<head><title>no</title>&#32;\n</head>b", "b"),
    ("<head><p>a</head><title>no</title><body>b", "a\n\nb"), ("<head><head><title>no</title><li>b", "- b"),
    ("<p>a<head><title>no</title>b", "ab"), ("<head><img src=x>b", "b"), ("<head>&amp;<title>no</title>", "&"),
])
def test_head_ends_where_the_body_begins(page, text):
    assert html_text.render(page) == text


class Plain(HTMLParser):
    """Words outside of hidden elements, for well-formed pages."""

    def __init__(self):
        super().__init__()
        self.hidden, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("head", "script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("head", "script", "style")

    def handle_data(self, data):
        if not self.hidden:
            self.words += data.split()


def test_all_visible_words_of_the_pages(spark):
    pages = table(spark, SF, "pages").withColumn("extra", F.lit(1))
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    for r in got.values():
        plain = Plain()
        plain.feed(r.html or "")
        squeezed = re.sub(r"^(- |\d+\. )", "", r.text, flags=re.M)
        assert "".join(squeezed.split()).replace("-", "") == "".join(plain.words).replace("-", "")


def test_broken_and_deep_pages():
    for page in ("<" * 9000, "<a " * 9000, '<a b="' * 3000, "<div>" * 20000 + "x", "<table><tr><td>" * 2000 + "x",
                 "<li>" * 9000, "<!--" * 5000, "<script>" * 3000, "<b><p>" * 4000, "<details>" * 3000, "<ul>" * 3000 + "<li>x"):
        html_text.render(page)


def test_pages_table_edge_cases(spark):
    df = spark.createDataFrame([(1, "<p>a", "t"), (1, "<p>a", "t"), (None, None, None)], "page_id long, html string, text string")
    out = html_text.extract(df)
    assert out.columns == ["page_id", "html", "text"]
    assert sorted((r.text for r in out.collect())) == ["", "a", "a"]
    assert html_text.extract(df.limit(0)).count() == 0


# --- pipeline --------------------------------------------------------------------------------------------------

def test_pipeline_equals_its_stages_one_by_one(spark):
    import corpus_pipeline
    from test_llm_near_duplicates import plain_components, plain_fingerprint
    from test_llm_filters import plain_hits

    docs = table(spark, SF, "documents")
    benchmark = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = seen
        seen = stage(spark, before, SF).cache()
        assert seen.columns == docs.columns, name
        ids = {r.doc_id for r in seen.select("doc_id").collect()}
        rows = {r.doc_id: r.text for r in before.select("doc_id", "text").collect()}
        if name == "near_duplicates":
            assert ids == set(plain_components({i: plain_fingerprint(t) for i, t in rows.items()}, 2).values())
        if name == "decontamination":
            hits = {i: plain_hits(t, benchmark) for i, t in rows.items()}
            assert ids == {i for i, (n, hit, _) in hits.items() if not (hit and 20 * hit >= n)}
    last = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in last.collect()} == ids
    assert set(last.columns) >= {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    assert set(queries.QUERIES) >= {"pipeline", *(q for q in queries.QUERIES if q.startswith("op"))}


def test_pipeline_stages_take_empty_documents(spark):
    import corpus_pipeline

    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
