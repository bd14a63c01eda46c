from pyspark.sql import functions as F

from leadloom.functions import html as H
from leadloom.functions.let import bind, let


def _fields(spark, html, fn):
    df = spark.createDataFrame([(html,)], "html string")
    return bind(df, let(H.tokens(F.col("html")), H.tree), lambda t: F.struct(fn(t).alias("out")), []).first()["out"]


def test_leaf_texts_skip_parents_silent_tags_and_repeats(spark):
    html = (
        "<DIV>own text<b>a</b></DIV><style>x{}</style><svg><path d='m'/></svg><p> </p><p>b&nbsp;c</p>"
        "<i>b c</i><p>text<br></p><span>&#322;&#x17c; &amp;lt;</span><em>a</em>"
    )
    df = spark.createDataFrame([(html,)], "html string")
    leaves = H.with_leaf_texts(df, "html").first()["leaves"]
    assert [(r["tag"], r["text"]) for r in leaves] == [("b", "a"), ("p", "b c"), ("span", "łż &lt;"), ("em", "a")]


def test_comments_and_scripts_do_not_hide_or_add_cards(values):
    html = "<!-- <a href='/x'>x</a> --><script>var s='<a href=\"/y\">y</a>';</script><a href='/z'><i>z</i></a>"
    assert values(lambda v: F.size(H.anchors(H.strip_silent(v))), html) == [1]


def test_attributes(values):
    tags = ['<a class="x" href="/p?a=1&amp;b=2">', "<a href='/q'>", "<a href=/r>", "<a data-href='/no'>", '<a href="">']
    assert values(lambda v: H.attribute(v, "href"), *tags) == ["/p?a=1&b=2", "/q", "/r", None, None]


def test_element_text_takes_children(spark):
    html = "<div><div>a <b>b</b></div> c</div><div>d</div>"
    assert _fields(spark, html, lambda t: H.element_text(t, F.lit(1))) == "a b c"
    assert _fields(spark, html, lambda t: H.close_of(t, F.lit(1))) == 6
    assert _fields(spark, html, lambda t: H.element_text(t, H.find_open(t, "div", F.lit(2)))) == "d"
    assert _fields(spark, html, lambda t: H.element_text(t, H.find_open(t, "h3"))) is None


def test_parent_and_siblings(spark):
    html = "<section><img src=x><div><i>1</i><h3>t</h3></div><p>x</p><br/><span>s</span></section><span>out</span>"
    h3 = lambda t: H.find_open(t, "h3")
    assert _fields(spark, html, lambda t: H.parent_of(t, h3(t))) == 3
    block = lambda t: H.parent_of(t, h3(t))
    assert _fields(spark, html, lambda t: H.element_text(t, H.later_sibling(t, block(t)))) == "x"
    assert _fields(spark, html, lambda t: H.element_text(t, H.later_sibling(t, block(t), ["span"]))) == "s"
    assert _fields(spark, html, lambda t: H.later_sibling(t, block(t), ["h2"])) is None
    assert _fields(spark, html, lambda t: H.parent_of(t, F.lit(1))) is None


def test_drop_repeats(spark):
    df = spark.createDataFrame([([1, 1, None, None, 2, 1],), ([],), ([5],)], "a array<int>")
    assert [r[0] for r in df.select(H.drop_repeats(F.col("a"))).collect()] == [[1, None, 2, 1], [], [5]]


def test_missing_and_stray_end_tags(spark):
    html = "<div><p>one<p>two<b>x</div></i><section><p>three</p></section>tail"
    first = lambda t: H.find_open(t, "p")
    assert _fields(spark, html, lambda t: t["levels"]) == ["1", "2", "3", "4", "/1", "", "1", "2", "/2", "/1"]
    assert _fields(spark, html, lambda t: H.close_of(t, first(t))) == 5
    assert _fields(spark, html, lambda t: H.element_text(t, first(t))) == "onetwox"
    assert _fields(spark, html, lambda t: H.element_text(t, H.later_sibling(t, F.lit(1)))) == "three"
    assert _fields(spark, html, lambda t: H.later_sibling(t, first(t))) is None
    assert _fields(spark, html, lambda t: H.parent_of(t, F.lit(4))) == 3
    assert _fields(spark, "<ul><li>a<li>b", lambda t: H.element_text(t, F.lit(1))) == "ab"
    assert _fields(spark, "<p>a<br>b<img src=x />c</p>", lambda t: H.element_text(t, F.lit(1))) == "abc"
