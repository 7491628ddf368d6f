"""Pages written by hand, in layouts that ``html_pages`` does not make, each with the blocks of its article."""

from __future__ import annotations

A = ["The ferry left the harbour before dawn, and nobody on the quay waved.", "It carried salt, two horses and a box of letters addressed to people who had long since moved away.", "By noon the wind had turned, so the captain decided to wait behind the island."]
B = ["Bread needs four things: flour, water, salt and time.", "Mix them in the evening and let the dough rest in a cool room until morning.", "Bake it hot, and listen to the crust as it cools."]
T, U = "A crossing in winter", "Bread without haste"


def p(items: list[str]) -> str:
    return "".join(f"<p>{x}</p>" for x in items)


PAGES = [
    # tables as a layout, with font tags
    (f"<html><body bgcolor=white><table width=100%><tr><td colspan=2><a href=/>Home</a> | <a href=/news>News</a> | <a href=/map>Map</a></td></tr><tr><td width=150 class=sidebar><a href=/1>One</a><br><a href=/2>Two</a></td><td id=content><h1><font size=5>{T}</font></h1>{p(A)}</td></tr><tr><td colspan=2 class=footer>&copy; 1999 The Webmaster</td></tr></table></body></html>", [T, *A]),
    # a blog with entry-content and a widget area
    (f"<body class='single post'><header class='site-header'><a href=/ rel=home>My small blog</a><ul id=menu-main class=menu><li><a href=/about>About</a><li><a href=/contact>Contact</a></ul></header><main><article class='post hentry'><h1 class=entry-title>{U}</h1><div class=entry-content>{p(B)}</div></article><div id=comments class=comments-area><h2>2 replies</h2><p>Lovely, I tried it and it was very good.</p></div></main><aside class=widget-area><h3>Archives</h3><ul><li><a href=/05>May</a></ul></aside><footer><p>Proudly powered by patience.</p></footer></body>", [U, *B]),
    # sections in a role=main division
    (f"<div role=banner><p>The Daily Post</p></div><div role=navigation><a href=a>World</a> <a href=b>Sport</a></div><div role=main><section><h1>{T}</h1>{p(A[:2])}</section><section><h2>The wait</h2>{p(A[2:])}</section></div><div role=contentinfo>Imprint · Terms</div>", [T, *A[:2], "The wait", *A[2:]]),
    # lists and a quotation inside the article
    (f"<nav><a href=/>Start</a></nav><article><h1>{U}</h1><p>{B[0]}</p><ul><li>500 grams of flour, sifted twice.</li><li>Ten grams of salt from the sea.</li></ul><blockquote>{B[1]}</blockquote><p>{B[2]}</p></article><footer>Contact us</footer>", [U, B[0], "500 grams of flour, sifted twice.", "Ten grams of salt from the sea.", B[1], B[2]]),
    # the text before the menu, in reversed source order
    (f"<body><div id=main><h1>{T}</h1>{p(A)}</div><div id=nav><ul><li><a href=/1>First</a></li><li><a href=/2>Second</a></li></ul></div><div id=footer>All rights reserved.</div></body>", [T, *A]),
    # a cookie notice and an advert between paragraphs
    (f"<div class='cookie-notice'><p>We use cookies to make this site better for everyone.</p><button>Accept</button></div><article><h1>{U}</h1><p>{B[0]}</p><div class='advert'><p>Buy our new oven today, only while stocks last.</p></div>{p(B[1:])}</article>", [U, *B]),
    # many divisions around, classes of a build tool
    (f"<div class=css-1q2w><div class=css-9x><div class=css-77><main class=css-0><div class=css-a1><div class=css-b2><h1>{T}</h1>{p(A)}</div></div></main></div></div><footer class=css-f><a href=/x>Legal</a> <a href=/y>Privacy</a></footer></div>", [T, *A]),
    # a form for a newsletter in the midst
    (f"<main><article><h1>{T}</h1><p>{A[0]}</p><form action=/s><p>Get our letter every week, free.</p><label>Mail</label><input name=m><button>Subscribe</button></form>{p(A[1:])}</article></main>", [T, *A]),
    # no closing tags at all
    (f"<html><head><title>x</title><body><nav><ul><li><a href=/>Home</a><li><a href=/b>Blog</a></ul></nav><article><h1>{U}</h1><p>{B[0]}<p>{B[1]}<p>{B[2]}</article><footer><p>&copy; 2024 Someone", [U, *B]),
    # inline markup, references, a picture with its caption
    ("<header><a href=/>Site</a></header><article><h1>Tea &amp; toast</h1><p>Tea is <b>hot</b>, toast is <i>crisp</i> &mdash; and <a href=/both>both</a> are served&nbsp;at five.</p><p>Sugar &lt;one spoon&gt; is added\n   by hand.</p></article><footer>Bye</footer>", ["Tea & toast", "Tea is hot, toast is crisp — and both are served at five.", "Sugar <one spoon> is added by hand."]),
    # related links after the article
    (f"<article><h1>{T}</h1>{p(A)}</article><aside class=related><h2>More stories</h2><ul><li><a href=/1>How we built the boat that sank</a></li><li><a href=/2>Ten islands to see this year</a></li></ul></aside>", [T, *A]),
    # a share bar and bread crumbs
    (f"<div class=breadcrumb><a href=/>Home</a> &gt; <a href=/food>Food</a></div><article><h1>{U}</h1>{p(B)}<div class=share><a href=#f>Share</a> <a href=#m>Mail</a></div></article>", [U, *B]),
    # a page of documentation with code
    ("<nav class=toc><ul><li><a href=#i>Install</a></li><li><a href=#u>Use</a></li></ul></nav><main><h1>Getting started</h1><p>Unpack the archive and open the folder in a terminal.</p><pre>make all</pre><h2>Use</h2><p>Call the program with the name of a file.</p></main>", ["Getting started", "Unpack the archive and open the folder in a terminal.", "make all", "Use", "Call the program with the name of a file."]),
    # capital tags, attributes without quotes, comments in the source
    (f"<HTML><BODY><!-- top --><NAV><A HREF=/>HOME</A></NAV><ARTICLE><H1>{T}</H1><P ALIGN=left>{A[0]}</P><!-- <p>old text</p> --><P>{A[1]}</P><P>{A[2]}</P></ARTICLE><FOOTER>END</FOOTER></BODY></HTML>", [T, *A]),
    # a forum: the first post is the article, answers are comments
    (f"<div id=header>Board index</div><article class=post><h1>{U}</h1>{p(B)}</article><section class=comments><div class=comment><p>Thanks, this helped me a lot.</p></div><div class=comment><p>It did not rise in my kitchen.</p></div></section>", [U, *B]),
    # scripts, styles and templates everywhere
    (f"<style>p{{color:red}}</style><article><script>var a='<p>no</p>';</script><h1>{T}</h1><p>{A[0]}</p><style>.x{{}}</style><p>{A[1]}</p><noscript><p>Please enable scripts.</p></noscript><p>{A[2]}</p></article><script>go()</script>", [T, *A]),
    # a hidden notice and a dialog
    (f"<div hidden class=hidden><p>You have been logged out.</p></div><dialog open><p>Welcome back to our site, dear reader.</p></dialog><main><h1>{U}</h1>{p(B)}</main>", [U, *B]),
    # a menu of many links as paragraphs
    (f"<div class=navigation><p><a href=/a>Politics</a></p><p><a href=/b>Economy</a></p><p><a href=/c>Science and nature</a></p></div><div class=article><h1>{T}</h1>{p(A)}</div><div class=foot><p>Made by hand.</p></div>", [T, *A]),
    # a description list and a table of data in the article
    (f"<article><h1>{U}</h1><p>{B[0]}</p><dl><dt>Flour</dt><dd>It should be fresh and finely milled.</dd></dl><p>{B[2]}</p></article><nav><a href=/>Back</a></nav>", [U, B[0], "Flour", "It should be fresh and finely milled.", B[2]]),
    # nothing but a menu
    ("<nav><ul><li><a href=/a>Politics</a></li><li><a href=/b>Economy</a></li></ul></nav><footer><p>&copy; 2020 Nobody</p></footer>", []),
]
