"""Pages with comments, quotes, drawings and style sheets: no visible word is lost, no hidden one shown."""

import random
import time

import pytest

from folioframe.llm import html_text


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>a<!-->b c</p><p>d</p>", "ab c\n\nd"), ("<p>a<!--->b</p>", "ab"), ("a<!-- x --!>b", "ab"), ("a<!---->b", "ab"), ("a<!-- <!-- no --> b", "a b"), ("a<!--no", "a"),
        ("<a href=x title=it's>Hello world's end</a> tail", "Hello world's end tail"), ('<a ="x">y</a> z', "y z"), ("<a href=\"x>y\" title='q>r'>t</a>", "t"), ("<a href=http://x/y/ class=c/>t</a><br/>u<img alt='p'/>", "t\nup"),
        ("<a b = 'c>d' e>f</a>", "f"), ("<p title = it's>g<p title='h'i='>'>j", "g\n\nj"), ("x < y <3 </ z", "x < y <3 </ z"),
        ("<svg><title>no</title><desc/><text x=1>drawn</text><text>two</text><defs>no</defs></svg> tail", "drawn two tail"), ("<math><mi>x</mi><mo>=</mo><semantics><mn>1</mn><annotation>no</annotation></semantics></math>", "x=1"), ("<desc>shown</desc>", "shown"),
        ("<style>.h{display:none} p.x, #y { visibility : hidden }</style><div class='g h'>no</div><p class=x>no <b style='visibility:visible'>yes</b></p><b id=y>no</b>end", "yes\n\nend"),
        ("<style>@media print{.z{display:none}} .a .b, .a:hover, .c.d, [x] {display:none} i{color:red}</style><i class=z>z</i><i class=a><i class=b>ab</i></i><i class='c d' x>cd</i>", "zabcd"),
        ("<style>.h{display:none!important} .k{display:none} #k{display:inline} p{display:none} p{display:block}</style><i class=h style='display:block'>no</i><i class=k style='display:block'>yes</i><i class=k id=k>also</i><p>too", "yesalso\n\ntoo"),
        ("<style><!-- .a{display:none} /* .b{display:none} */ --></style><i class=a>no</i><i class=b>yes</i>", "yes"), ("<style>.a{display:none</style><i class=a>no</i>b", "b"),
    ],
)
def test_what_is_seen(html, want):
    assert html_text.render(html) == want


def test_pages_of_pieces_that_hide_or_show():
    """Pieces in any order; each says which of its words are seen."""
    r = random.Random(23)
    word = iter(f"w{k}x" for k in range(10**6))
    sheet = "<style>.gone, b.off { color: red; display: none } #dark{visibility:hidden}</style>"
    shows = [
        "<!-->{0} ", "<!--->{0} ", "<!-- no --!>{0} ", "<!-- it's > no -->{0} ", "<a href=x'y title=a\"b>{0}</a> ", "<i =\"'>{0}</i> ", "<p data-x='a>b' y>{0} ", "<svg><g><text>{0}</text></g></svg> ", "<math><mi>{0}</mi></math> ",
        "<b class='of f'>{0}</b> ", "<i class=off>{0}</i> ", "<img alt={0}> ", "{0} & < > </ ", "<br/>{0} ", "<div class=shown>{0}</div> ", "<td>{0} ", "</p>{0} ", "<svg/>{0} ", "<b id=dark><i style='visibility:visible'>{0}</i></b> ",
    ]
    hides = ["<!-- {0} -->", "<i class='x gone'>{0}</i>", "<b class=off>{0}</b>", "<u id=dark>{0}</u>", "<svg><desc>{0}</desc></svg>", "<span hidden title=a'b>{0}</span>", "<a title='{0}'></a>", "<script>'<!-->{0}'</script>", "<a title=\"<p>{0}\"></a>", "<math><annotation>{0}</annotation></math>"]
    for _ in range(300):
        seen, unseen, html = [], [], sheet
        for _ in range(25):
            w = next(word)
            shown = r.random() < 0.6
            html += r.choice(shows if shown else hides).format(w)
            (seen if shown else unseen).append(w)
        text = html_text.render(html)
        assert all(text.count(w) == 1 for w in seen) and not any(w in text for w in unseen), html


def test_hostile_tags_and_sheets_take_little_time():
    n = 100_000
    for html in ("<a " + "x" * n + ">deep", "<a" + " =" * n + ">deep", "<a " + "x= " * n + ">deep", "<a " + "x='' " * n + ">deep", "<a x" + " " * n + "y>deep", "deep" + "<a '" * n, "<!-" * n + ">deep", "deep<!--" + "-" * n, "deep<style>" + "{" * n, "deep<style>" + "@a;" * n, "deep<style>" + ".a,b" * n + "{display:none}", "<style>" + "".join(f".c{k}{{display:block}}" for k in range(2000)) + "</style>" + "<i class='c1 c2'>" * 2000 + "deep", "deep<style>.a{" + "display:" * n):
        began = time.process_time()
        assert "deep" in html_text.render(html) and time.process_time() - began < 8, html[:30]
