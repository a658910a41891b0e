"""Pages with main text marked by hand: data-main="1" opens it, data-main="0" what is not part of it."""

_LONG = "The river rose in the night, and by morning the lower fields were under water. People moved their animals to the hill, then waited."
_MORE = "Nobody had seen the like since the old bridge fell, said the keeper of the mill. Two boats were tied to the church door, just in case."
_NEXT = "On the third day the rain stopped. Repairs will take until spring, the council thinks, if the frost holds off."
_TAIL = "It was late."
_MENU = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">World</a></li><li><a href="/c">Sport</a></li><li><a href="/d">Contact</a></li></ul></nav>'
_SHORT = "".join(f"<p>{x}</p>" for x in ("It rained.", "The mill stood still. Nobody came.", "Late at night, the dogs barked at the water.", "So they went, one by one, up to the hill.", "What now? Wait, said the keeper of the mill.", "Three days, then. No more, he hoped.", "The church door was open. Inside, two lamps burned, and a child slept on a bench."))
_HEAD = "<!DOCTYPE html><html><head><title>Flood</title><style>p{}</style></head>"

PAGES = [
    f'{_HEAD}<body>{_MENU}<div class="ad">Buy two boats, get one free today only.</div><article data-main="1"><h1>Flood in the valley</h1><p>{_LONG}</p><p>{_MORE}</p><p>{_TAIL}</p></article><footer>&copy; Valley News. All rights reserved, see our terms.</footer></body></html>',
    f'{_HEAD}<body><header><div class="logo">Valley News</div>{_MENU}</header><main data-main="1"><h1>Flood</h1><p>{_LONG}<p>{_NEXT}<div class="advert" data-main="0">Sponsored: boats at half price, call now.</div><p>{_MORE}</p><ul><li>Bring warm clothes.</li><li>Bring food for two days.</li></ul></main><aside class="sidebar"><h3>Most read</h3><ul><li><a href="/x">Ten mills to see</a></li><li><a href="/y">Bridges</a></li></ul></aside><footer><p>Contact us. Privacy.</p></footer></body></html>',
    f'{_HEAD}<body><div id="header"><a href="/">Valley</a><div class="menu"><a href="/a">Home</a> <a href="/b">News</a></div></div><div id="cookie-notice" class="notice">We use cookies to make this site better. By staying you agree to our policy.</div><div id="content" data-main="1"><h1>Flood</h1><div class="entry"><p>{_LONG}</p><h2>What comes next</h2><p>{_NEXT}</p><blockquote>{_MORE}</blockquote></div></div><div id="sidebar"><p>About this blog: we write about rivers, mills and boats.</p><form><p>Search this site</p></form></div><div id="footer">Copyright Valley. Imprint.</div></body></html>',
    f'{_HEAD}<body>{_MENU}<article data-main="1"><header><h1>Flood</h1></header><section><p>{_LONG}</p><p>{_MORE}</p><table><tr><th>Day</th><th>Level</th></tr><tr><td>Monday</td><td>3 m</td></tr></table><p>{_NEXT}</p></section><section class="comments" data-main="0"><h2>Comments</h2><div class="comment"><p>Great report, I was there and saw the water come up to the door. Thanks for this!</p></div><div class="comment"><p>My uncle lost his boat, he says it was worse in the old days, believe me.</p></div></section></article><footer><p>Valley News, since 1901.</p></footer></body></html>',
    f'{_HEAD}<body><div class="breadcrumb"><a href="/">Home</a> / <a href="/n">News</a></div><h1 data-main="1">Flood</h1><p data-main="1">{_LONG}</p><p data-main="1">{_MORE}</p><p data-main="1">{_NEXT}</p><div class="share">Share this page with your friends.</div><div class="related"><h3>Related</h3><ul><li><a href="/1">Old floods of the valley</a></li></ul></div><form class="newsletter"><p>Subscribe to our newsletter and get the news each morning, free of charge.</p></form></body></html>',
    f'{_HEAD}<body><div class="banner promo">Summer sale! Everything must go, up to half off.</div><div class="topnav"><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></div><div class="post" data-main="1"><h2>Flood</h2><p>{_MORE}</p><p>{_LONG}</p><div class="ad" data-main="0"><p>Advertisement. Boats and oars, new and used, at the lake.</p></div><p>{_TAIL}</p><pre>level = 3</pre></div><div class="popup modal"><p>Sign up now to read more of our stories every day.</p></div><div class="footer"><p>All rights reserved. Terms of use.</p></div></body></html>',
    f'{_HEAD}<body><div class="wrapper"><div class="header">Valley</div><div class="nav"><a href="/a">Home</a></div><div class="main" data-main="1"><div class="article-body"><p>{_LONG}</p><p>{_NEXT}</p><p>{_MORE}</p><figure><figcaption>The mill on Monday.</figcaption></figure><dl><dt>Level</dt><dd>Three metres at noon.</dd></dl></div></div><div class="comments" id="comments"><p>Reader says: I do not believe a word of this, it never rained that much.</p><ol><li>Nice one, keep it up and write more about the mill.</li></ol></div><div class="widget"><p>Follow us for daily updates, photos and more.</p></div></div></body></html>',
    f'{_HEAD}<body><nav class="site-menu"><p>Menu</p>{_MENU}</nav><div role="main" data-main="1"><h1>Flood</h1><p>{_LONG}</p><div><p>{_MORE}</p><p>{_NEXT}</p></div><h3>Later</h3><p>{_TAIL}</p></div><div role="complementary" class="side-bar"><p>Weather today: rain, then more rain, with wind from the west.</p></div><div class="alert warning"><p>This site will be down for maintenance on Sunday night.</p></div><footer class="site-footer"><ul><li><a href="/t">Terms</a></li></ul><p>Made in the valley by friends of the river.</p></footer></body></html>',
    f'{_HEAD}<body>{_MENU}<div class="disclaimer notice"><p>Views are those of the writer and not of this paper, which takes no blame.</p></div><section class="content" data-main="1"><h1>Flood</h1><p>{_NEXT}</p><p>{_LONG}</p><aside class="related-links" data-main="0"><p>See also: ten mills worth a visit this summer.</p></aside><p>{_MORE}</p></section><div class="login form"><form><p>User name and password, please, to join in.</p></form></div><div class="sponsor ads"><p>Sponsored by the boat house, open all week long.</p></div></body></html>',
    f'{_HEAD}<body>{_MENU}<p>Skip to content</p><article data-main="1"><h1>{_TAIL}</h1><p><b>{_TAIL}<br></article><footer>&copy; valley.example &middot; {_TAIL}</footer></body></html>',
    f'{_HEAD}<body>{_MENU}<div class="ad">{_LONG}</div><article data-main="1"><h1>{_MORE}</h1><p><b>{_NEXT}<br><p>{_LONG}</p><p>{_TAIL}</p><p>{_MORE}</p></article><footer>&copy; valley.example &middot; {_NEXT}</footer></body></html>',
    f'{_HEAD}<body><div class="top"><h1 data-main="1">Flood</h1></div><div class="story" data-main="1"><p>{_LONG}</p><p>{_MORE}</p></div><div class="reader-comments"><p>It is long, I think. Well, it is very long, and wet.</p></div></body></html>',
    f'{_HEAD}<body><div><div data-main="1"><p>{_LONG} {_MORE}</p></div></div><div class="menu"><a href="/">Start</a></div></body></html>',
    f'{_HEAD}<body>{_MENU}<div class="page"><div class="text" data-main="1"><h1>Flood</h1><p>{_NEXT}</p><p>{_TAIL}</p><p>{_MORE}</p></div></div><footer>{_LONG}</footer></body></html>',
    f'{_HEAD}<body>{_MENU}<div class="ad">{_NEXT}</div><article data-main="1"><h1>{_LONG}</h1><p>{_LONG}</p><p>{_TAIL}</p><p>It.</p><p>{_MORE} {_LONG} {_NEXT} {_MORE} {_LONG}</p><p>Late | in | the | night | it | rose</p></article><footer>&copy; valley.example</footer></body></html>',
    f'{_HEAD}<body><p data-main="1">{_LONG}</p><p data-main="1">{_TAIL}</p></body></html>',
    f'{_HEAD}<body><div data-main="1">{_LONG} {_NEXT}</div></body></html>',
    f'{_HEAD}<body>{_MENU}<article data-main="1"><h1>The mill in the rain</h1>{_SHORT}<p>{_LONG}</p>{_SHORT}</article><footer>All rights reserved. Valley.</footer></body></html>',
    f'{_HEAD}<body>{_MENU}<div class="entry-text" data-main="1"><h2>The mill. A tale, in short.</h2>{_SHORT}</div><div class="comments"><p>So it was. I saw it, too.</p></div><footer>{_SHORT}</footer></body></html>',
    f'{_HEAD}<body>{_MENU}<div class="ad">The boat house, now open.</div><article data-main="1"><h1>Rain</h1><p>Up | to | the | hill | they | went, | all</p>{_SHORT}<p>{_MORE} {_LONG}</p></article><footer>&copy; valley.example &middot; The church door was open.</footer></body></html>',
]
