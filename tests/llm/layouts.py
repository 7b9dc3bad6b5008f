"""Page layouts written by hand, with the main text that a reader would mark. {0} to {7} are the paragraphs below; what
else stands in a layout is boilerplate unless its second part names it. QUOTED are layouts that once failed."""

PARAGRAPHS = [
    "The river rises in the hills above the town, and for most of its length it is narrow. Boats go no further than the mill, where a weir was built in the last century.",
    "In spring the water covers the meadows and the road; people then walk along the dam. It was built long ago, and nobody knows by whom.",
    "The oldest map shows the dam already, with a chapel at its end, two barns and a row of poplars. Of these only the chapel is left, though its roof fell in during the war.",
    "Every few years there is talk of a bridge. Plans were drawn three times, money was found once, and a pillar still stands in the reeds to remind us of it.",
    "Fishing is allowed from the first of May. Visitors need a paper from the office, which is open on Mondays only, and which closes early when the weather is good.",
    "What the town lives on is hard to say. There was a tannery, then a factory for buttons, and after that a school for foresters that moved away eleven years ago.",
    "Most of the young leave and some of them come back. Those who do tend to buy a house near the water, in spite of all that they were told as children.",
    "A small museum keeps the tools of the tanners. Its warden shows them to anyone who asks and has been known to open it at night.",
]
LONG = [" ".join(PARAGRAPHS[i:] + PARAGRAPHS[:i]) for i in range(8)]
NAV = "<nav><ul><li><a href=/>Home</a><li><a href=/n>News</a><li><a href=/t>Town</a></ul></nav>"
FOOT = "<footer>Copyright 2024 The Town Paper. All rights reserved.</footer>"

#: (layout, expected text); "P" stands for all paragraphs that the layout uses, in order.
QUOTED = [
    ("<div id=k1>Home | Town | Sport</div><div id=k2><p>{L0}</p><p>{L1}</p><p>{L2}</p><p>{L3}</p><p>{L4}</p><p>{L5}</p><p>{L6}</p><p>{L7}</p></div><div id=k3><a href=/a>About</a> <a href=/b>Terms</a></div>", "P"),
    ("<p>{0}<p>{1}", "P"),
    ("<p>One short line.<p>And another one.", "One short line. And another one."),
    ("<div id=x7><p>{0}</p><p>{1}</p></div>", "P"),
    ("<article><p>See <a href=/m>the long story of the mill</a> and <a href=/n>the map of the dam in two parts</a>.</p><p>{0}</p></article>", "See the long story of the mill and the map of the dam in two parts. {0}"),
    ("<article><p>{0}</p><div class=search-results><p>{1}</p></div><p>{2}</p></article>", "P"),
    (NAV + "<article><h1>The dam</h1><p class=byline>By A. Writer</p><p>{0}</p><p>{1}</p><footer>Tags: <a href=/x>dam</a>, <a href=/y>river</a></footer></article>", "The dam {0} {1}"),
]
LAYOUTS = [
    (NAV + "<article><h1>A town</h1><p>{0}</p><p>{1}</p></article>" + FOOT, "A town {0} {1}"),
    (NAV + "<div><p>{0}</p><p>{1}</p><p>{2}</p></div>" + FOOT, "P"),
    ("<header><a href=/>Town Paper</a></header><div id=q1><div id=q2><p>{0}</p><p>{3}</p></div></div>" + FOOT, "P"),
    ("<p>{0}</p><p>{1}</p><p>{2}</p><p>{3}</p>", "P"),
    (NAV + "<p>{4}</p><p>{5}</p>" + FOOT, "P"),
    ("<div class=r><div class=c1><a href=1>One</a><a href=2>Two</a><a href=3>Three</a></div><div class=c2><p>{0}</p><p>{5}</p><p>{6}</p></div></div>", "P"),
    ("<main><h2>Fishing</h2><p>{4}</p><ul><li>Rods are let at the mill.</li><li>Dogs stay on the lead.</li></ul><p>{7}</p></main>" + FOOT, "Fishing {4} Rods are let at the mill. Dogs stay on the lead. {7}"),
    ("<main><p>{0}</p><blockquote>{1}</blockquote><p>{2}</p></main><aside><h3>More to read</h3><ul><li><a href=1>Bridges</a><li><a href=2>Boats</a></ul></aside>", "P"),
    ("<section><h1>Bridge</h1><p>{3}</p></section>" + FOOT, "Bridge {3}"),
    ("<div id=cookie-bar><p>We use cookies to make this site work. <button>Accept</button></p></div><article><p>{0}</p><p>{1}</p></article>", "P"),
    ("<article><p>{0}</p><div class=ad>Buy boots now, half price until Sunday.</div><p>{1}</p></article>", "P"),
    ("<article><p>{0}</p><p>{1}</p></article><section class=comments><h3>Comments</h3><p><b>Ann</b> I have seen the pillar, it is quite small.</p><p><b>Bo</b> So have I.</p></section>", "P"),
    ("<div class=page><div class=main-col><p>{2}</p><p>{3}</p></div><div class=sidebar><h3>Popular</h3><ul><li><a href=1>Ten walks</a><li><a href=2>Where to eat</a></ul></div></div>", "P"),
    ("<table><tr><td><a href=1>Home</a><br><a href=2>Links</a></td><td><p>{0}</p><p>{6}</p></td></tr></table>", "P"),
    ("<div class=post><div class=post-body><p>{5}</p><p>{6}</p><p>{7}</p></div><div class=share-buttons><a href=1>Tweet</a> <a href=2>Mail</a></div></div>", "P"),
    ("<article><header><h1>Tanners</h1></header><p>{5}</p><p>{7}</p></article>" + FOOT, "Tanners {5} {7}"),
    ("<article><p>Ask <a href=/o>the office</a> on <a href=/d>Mondays</a>, or <a href=/w>write</a> to <a href=/p>the parish</a>.</p><p>{4}</p></article>" + FOOT, "Ask the office on Mondays, or write to the parish. {4}"),
    (NAV + "<div class=widget><p>{0}</p><p>{1}</p><p>{2}</p><p>{3}</p></div>" + FOOT, "P"),
    ("<div id=header-text><p>{L0}</p><p>{L2}</p></div><div id=z><a href=1>Next</a></div>", "P"),
    ("<article><h1>Plans</h1><div>{3}</div><div>{0}</div></article>", "Plans {3} {0}"),
    ("<article><h2>One</h2><p>{0}</p><h2>Two</h2><p>{1}</p><h2>Three</h2><p>{2}</p></article>" + FOOT, "One {0} Two {1} Three {2}"),
    ("<article><p>{0}</p><figure><img src=a><figcaption>The weir in winter.</figcaption></figure><p>{1}</p></article>", "{0} The weir in winter. {1}"),
    ("<article><p>{0}</p><pre>depth 3 m\nwidth 40 m</pre></article>" + FOOT, "{0} depth 3 m width 40 m"),
    ("<div class=a1><div class=a2><div class=a3><div class=a4><p>{6}</p><p>{7}</p></div></div></div></div>" + FOOT, "P"),
    ("<form class=search><label>Search</label><input name=q><button>Go</button></form><main><p>{1}</p><p>{2}</p></main>", "P"),
    ("<article><p>{4}</p></article><div class=newsletter><p>Sign up for our letter and get the news each week.</p><input name=m><button>Sign up</button></div>" + FOOT, "P"),
    ("<div class=breadcrumb><a href=1>Town</a> &gt; <a href=2>Water</a></div><div class=text><p>{0}</p><p>{4}</p></div><div class=pager><a href=1>Older</a> <a href=2>Newer</a></div>", "P"),
    ("<section id=s1><p>{0}</p></section><section id=s2><p>{1}</p></section><section id=s3><p>{2}</p></section>" + FOOT, "P"),
    ("<div class=story><p>{0}<p>{1}<p>{2}</div><div class=related-stories><a href=1>Older story</a><a href=2>Another story</a></div>", "P"),
    ("<article><ol><li>{0}</li><li>{1}</li></ol></article>" + FOOT, "P"),
    ("<div>{L3}</div>", "P"),
    ("{0}<p>{1}", "P"),
    ("<article><p>{0}</p><aside class=related><a href=1>See the mill</a></aside><p>{2}</p></article>", "P"),
    ("<article><h1>Museum</h1><p>{7}</p><div class=tags><a href=1>tools</a> <a href=2>tanners</a></div></article>" + NAV, "Museum {7}"),
    (NAV + "<main><article><p>{0}</p><p>{1}</p></article></main>" + FOOT, "P"),
    ("<div role=main><p>{2}</p><p>{5}</p></div><div role=contentinfo>Imprint and contact</div>", "P"),
    ("<article><p>{0}</p></article><div id=disqus><p>Nice. I would like to read more of this.</p></div>", "P"),
    ("<div class=topbar><a href=1>Log in</a></div><div class=entry><h2>Floods</h2><p>{1}</p><p>{3}</p></div>" + FOOT, "Floods {1} {3}"),
    ("<div class=col><p>{0}</p><p>{1}</p></div><div class=col><h4>Links</h4><ul><li><a href=1>A</a><li><a href=2>B</a><li><a href=3>C</a></ul></div>", "P"),
]

#: Layouts written after the generator was done, and never used to change it: these tell how it does on unknown pages.
UNSEEN = [
    ("<dl><dt>The weir</dt><dd>{0}</dd><dt>The dam</dt><dd>{1}</dd></dl>" + FOOT, "The weir {0} The dam {1}"),
    ("<div class=qa><h3>Who built the dam?</h3><p>{1}</p><h3>May one fish?</h3><p>{4}</p></div><div class=footer-links><a href=1>Help</a> <a href=2>Jobs</a></div>", "Who built the dam? {1} May one fish? {4}"),
    ("<details open><summary>History</summary><p>{2}</p></details><p>{5}</p>" + FOOT, "History {2} {5}"),
    ("<center><font><p>{0}</p><p>{6}</p><hr><a href=1>Back</a></font></center>", "P"),
    ("<div class=product><h1>Wading boots</h1><p>{4}</p><ul><li>Rubber, lined</li><li>Sizes 38 to 47</li></ul></div><div class=recommended><a href=1>Socks</a> <a href=2>Nets</a></div>", "Wading boots {4} Rubber, lined Sizes 38 to 47"),
    ("<article><p>{0}</p><div class=promo-box><p>Subscribe today and save ten per cent.</p></div><p>{3}</p><p>{6}</p></article>" + FOOT, "P"),
    ("<div><div><ul><li><a href=1>First</a><li><a href=2>Second</a></ul></div><div><p>{7}</p><p>{6}</p><p>{5}</p></div><div><ul><li><a href=3>Third</a><li><a href=4>Fourth</a></ul></div></div>", "P"),
    ("<main><table><tr><th>Year</th><th>Height</th></tr><tr><td>1901</td><td>4.2 m</td></tr></table><p>{1}</p></main>" + FOOT, "Year Height 1901 4.2 m {1}"),
    (NAV + "<div id=content><p>{L0}</p><p>{L1}</p><p>{L2}</p><p>{L3}</p><p>{L4}</p></div><div id=comments><p>Well written.</p><p>I do not agree with the second part at all, the dam is much older than that.</p></div>" + FOOT, "P"),
    ("<div class=ad-hoc-report><p>{3}</p><p>{0}</p></div>" + FOOT, "P"),
    ("<section class=hero><h1>Museum of tools</h1></section><section><p>{7}</p><p>{5}</p></section><footer><p>The museum is run by the parish and lives on gifts.</p></footer>", "Museum of tools {7} {5}"),
    ("<article><h1>Verse</h1><p>The water came<br>and went again<br>and left the reeds<br>in sun and rain</p></article>" + NAV, "Verse The water came and went again and left the reeds in sun and rain"),
    ("<div class=wrapper><header><div>Town Paper</div></header><div class=layout><div class=text-column><p>{2}</p><p>{3}</p></div><div class=ads><p>Boats for hire, all sizes.</p></div></div></div>", "P"),
    ("<p>{0}</p><div class=share><a href=1>Share</a></div><p>{1}</p><div class=cookie>This page sets cookies.</div>", "P"),
    ("<div id=main-text>{2}<br><br>{3}<br><br>{6}</div><div id=menu-bottom><a href=1>Up</a> <a href=2>Home</a></div>", "P"),
    ("<article lang=de><h1>Der Fluss</h1><p>Der Fluss entspringt in den Bergen, und bis zur Mühle ist er schmal. Danach wird er breiter, und im Frühjahr steht die Straße unter Wasser.</p></article><aside>Werbung</aside>", "Der Fluss Der Fluss entspringt in den Bergen, und bis zur Mühle ist er schmal. Danach wird er breiter, und im Frühjahr steht die Straße unter Wasser."),
    ("<div class=lead><p>{5}</p></div><div class=body-copy><p>{6}</p><p>{7}</p></div><div class=login><form><label>Name</label><input name=n></form></div>", "P"),
    ("<article><p>{0}</p><h3>Notes</h3><ol><li>The weir was rebuilt.</li><li>The mill is private.</li></ol></article><div class=pagination><a href=2>2</a> <a href=3>3</a></div>", "{0} Notes The weir was rebuilt. The mill is private."),
    ("<body><div class=k><h2>Floods</h2><p>{1}</p></div><div class=k><h2>Bridges</h2><p>{3}</p></div><div class=k><h2>Fishing</h2><p>{4}</p></div>", "Floods {1} Bridges {3} Fishing {4}"),
    ("<header><h1>Town Paper</h1><p>News since 1901</p></header>" + NAV + "<div class=column><p>{4}</p><p>{2}</p></div>" + FOOT, "P"),
]


def pages(layouts):
    """(html, expected text) of the layouts."""
    names = {str(i): p for i, p in enumerate(PARAGRAPHS)} | {f"L{i}": p for i, p in enumerate(LONG)}

    def filled(text):
        for name, paragraph in names.items():
            text = text.replace("{" + name + "}", paragraph)
        return text

    out = []
    for layout, expected in layouts:
        used = sorted((layout.index("{" + n + "}"), p) for n, p in names.items() if "{" + n + "}" in layout)
        want = " ".join(p for _, p in used) if expected == "P" else filled(expected)
        out.append((f"<!DOCTYPE html><html><head><title>Town</title></head><body>{filled(layout)}</body></html>", want))
    return out
