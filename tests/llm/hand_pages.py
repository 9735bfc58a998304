"""Pages written by hand in shapes of their own, with the text that belongs to their articles."""

P1 = "The river had been rising since Tuesday, and by the weekend the lower fields were under water."
P2 = "Farmers moved what cattle they could to the hill above the village, where the church stands."
P3 = "Nobody could remember a spring like it, said the old ferryman, who keeps a record of every flood."
P4 = "The council will meet again next month to decide whether the dam should be raised by a metre."

PAGES = {
    "table layout": (
        f"""<html><body><table width=100%><tr><td colspan=3 class=banner>The Valley Gazette</td></tr><tr>
        <td class=leftnav><a href=/>Home</a><br><a href=/news>News</a><br><a href=/sport>Sport</a><br><a href=/contact>Contact</a></td>
        <td><h1>Flood reaches the lower fields</h1><p>{P1}<p>{P2}<p>{P3}</td>
        <td class=ads><a href=/buy>Buy boots now</a><p>Sponsored: cheap wellingtons</td></tr>
        <tr><td colspan=3 class=footer>Copyright 2019 Valley Gazette. All rights reserved.</td></tr></table></body></html>""",
        "\n".join(["Flood reaches the lower fields", P1, P2, P3]),
    ),
    "nested divs with ids": (
        f"""<!doctype html><html lang=en><head><meta charset=utf-8><title>t</title><script>var a = "<p>no</p>";</script></head><body>
        <div id="page"><div id="masthead"><a href="/">Valley Gazette</a></div><div id="navigation"><ul><li><a href="/a">World</a></li><li><a href="/b">Local</a></li></ul></div>
        <div id="content"><div id="main"><h2>Flood reaches the lower fields</h2><div class="entry"><p>{P1}</p><p>{P2}</p><ul><li>{P3}</li><li>{P4}</li></ul></div></div>
        <div id="sidebar"><h3>Most read</h3><ul><li><a href="/1">Bridge closed</a></li><li><a href="/2">Market day</a></li></ul></div></div>
        <div id="footer"><p>Terms of use and privacy</p></div></div></body></html>""",
        "\n".join(["Flood reaches the lower fields", P1, P2, P3, P4]),
    ),
    "comments and a cookie notice": (
        f"""<html><head><title>x</title></head><body><div class="cookie-consent">We use cookies to improve this site. <button>Accept</button></div>
        <header><nav><a href=/>Home</a> <a href=/about>About</a></nav></header><main><article><header><h1>A spring like no other</h1></header>
        <p>{P3}</p><blockquote>{P4}</blockquote><p>{P1}</p></article>
        <section class="comments"><h3>3 comments</h3><div class="comment"><b>anna</b> says: <p>I remember the one before, it was far worse than this.</p></div>
        <div class="comment"><b>tom</b><p>Great article, thanks for posting it here.</p></div></section></main>
        <footer>&copy; 2020 The Gazette</footer></body></html>""",
        "\n".join(["A spring like no other", P3, P4, P1]),
    ),
    "sections without classes": (
        f"""<html><body><nav><ul><li><a href=/>Start</a></li><li><a href=/all>All articles</a></li></ul></nav>
        <section><h1>The dam</h1><p>{P4}</p><p>{P2}</p><h2>What comes next</h2><p>{P1}</p></section>
        <form action=/search><label>Search</label><input name=q><button>Go</button></form><footer><p>Imprint and contact</p></footer></body></html>""",
        "\n".join(["The dam", P4, P2, "What comes next", P1]),
    ),
    "formulas and references": (
        f"""<head><title>Levels</title><p>{P1}</p><div class=post><h1>How high is a metre &amp; a half?</h1>
        <p>The level is <math><mi>h</mi><mo>=</mo><mn>1.5</mn></math> metres &mdash; more than ever.</p><p>{P3}</p></div>
        <div class=sidebar><h4>Related</h4><a href=/x>Older floods</a> <a href=/y>Newer floods</a></div>""",
        "\n".join([P1, "How high is a metre & a half?", "The level is h=1.5 metres — more than ever.", P3]),
    ),
    "a blog with an advert inside": (
        f"""<html><body><div class="site-header"><h1><a href="/">My valley blog</a></h1><p>Notes from the river</p></div>
        <div class="blog-post"><h2 class="post-title">Water in the cellar</h2><p>{P2}</p><div class="advert"><p>Buy one pump, get one free! Offer ends soon.</p></div>
        <p>{P3}</p><p>{P4}</p><div class="share"><a href=#>Tweet</a> <a href=#>Share</a></div></div>
        <div class="widget"><h3>Archive</h3><ul><li><a href=/1>May</a></li><li><a href=/2>June</a></li></ul></div></body></html>""",
        "\n".join(["Water in the cellar", P2, P3, P4]),
    ),
    "no article at all": (
        """<html><body><nav><a href=/>Home</a><a href=/login>Login</a></nav><form><label>Email</label><input><button>Subscribe</button></form><footer>All rights reserved</footer></body></html>""",
        "",
    ),
}
