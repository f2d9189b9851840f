"""Pages written by hand for training: blocks of main text start with MARK, all others are menus, notices, comments and the like.

They show the usual layouts: with article or main, with named content, with neither; long and short text, lists, tables,
quotations, captions and headings in it; and around it what sites put there.
"""

MARK = "@@"
PAGES = (
    # a news page
    """<html><head><title>n</title></head><body><header><a href=/>Daily Herald</a><p>Independent since 1901</p></header><nav><ul><li><a href=/w>World</a>
<li><a href=/b>Business</a><li><a href=/s>Sport</a></ul></nav><div class="cookie-banner"><p>We use cookies to improve your visit. By going on you agree to our use of them.</p><button>Accept</button></div><div>Read the printed paper at half the price for a month: call us or come by</div>
<article><h1>@@Council votes to rebuild the old bridge</h1><p class=byline>@@By Jane Doe</p><p>@@The city council voted on Tuesday to rebuild the bridge over the river, which has been closed since the flood of last spring.</p>
<p>@@Work is to begin in May.</p><blockquote>@@It is about time, said one of the shopkeepers.</blockquote><div class="ad">Buy one, get one free at the corner shop all through this week!</div>
<p>@@The costs are put at four million, of which the state pays half; the rest is to come from a loan that runs for twenty years.</p><aside><h3>More on this</h3><p>How the flood of last spring came about, and who pays for it now</p></aside>
<figure><img src=x><figcaption>@@The bridge in March.</figcaption></figure></article><section id=comments><h2>Comments</h2><p>About time! I have had to drive around the hill for a year now, and so have all of my neighbours.</p><p>Who pays?</p></section>
<footer><p>&copy; 2020 Daily Herald. All rights reserved. No part of this page may be copied without leave.</p><a href=/p>Privacy</a></footer></body></html>""",
    # a blog post in main
    """<body><div class="topbar"><a href=/>My garden blog</a></div><div>Seeds, soil and small mishaps</div><main><h1>@@Tomatoes</h1><p>@@This year I tried <a href=/x>three kinds</a> of tomatoes on the balcony, and only one of them did well.</p>
<h2>@@What went wrong</h2><ul><li>@@Too much water</li><li>@@Too little sun in June</li></ul><p>@@Next year I will plant them a month later and leave out the big pots.</p><p>@@See you then!</p>
<div class="share-buttons"><a href=t>Tweet</a> <a href=f>Share</a></div><div class="related-posts"><h3>You may also like</h3><ul><li><a href=1>Beans on a balcony</a></li><li><a href=2>My war with the slugs</a></li></ul></div></main>
<div id="sidebar"><h3>About me</h3><p>I live in a small flat with a large balcony and write about what grows on it.</p><h3>Archive</h3><ul><li><a href=a>May</a></li><li><a href=b>June</a></li></ul></div><footer>Powered by a small server</footer></body>""",
    # a page of documentation, content by name only
    """<body><div class="navbar"><a href=/>Home</a><a href=/d>Docs</a><a href=/f>Forum</a></div><div id="content"><h1>@@Installing</h1><p>@@Download the archive and unpack it.</p><pre>@@tar xf tool.tar</pre>
<p>@@Then run the setup, which asks for a folder and takes about a minute on a usual machine.</p><table><tr><th>@@Option</th><th>@@Meaning</th></tr><tr><td>@@-v</td><td>@@more messages</td></tr></table></div>
<div class="footer">Version 2 of the manual. Found a mistake in it? Tell us about it and we will mend it.</div></body>""",
    # an old page without any marks: tables for layout
    """<html><body><table><tr><td><a href=1>Home</a></td><td><a href=2>Pictures</a></td><td><a href=3>Guestbook</a></td></tr></table><center><h2>@@The history of our village mill</h2></center>
<p>@@The mill was built by two brothers in 1780 and has stood by the brook ever since, though the wheel was lost in a storm.</p><p>@@It ground flour for the whole valley until the railway came and the big mills of the town took over the trade.</p>
<p>@@Today it is a museum.</p><p>@@Visitors can see the stones, the gears and the room of the miller, and on Sundays bread is baked in the old oven behind the house.</p><font size=1><a href=m>Mail</a> | <a href=t>Top</a></font><p>Made in 2003</p></body></html>""",
    # a forum thread: the first post is the text, replies are not
    """<body><nav><a href=/>Board</a> <a href=/q>Questions</a></nav><div class="post"><h1>@@How do I sharpen a plane iron?</h1><p>@@I have an old plane and two stones, a coarse and a fine one. How long do I stay on each, and do I need a strop?</p><p>@@Thanks!</p></div>
<div class="replies"><div class="reply"><p>Ten strokes on the coarse stone until you feel a burr, then the fine one until it is gone.</p></div><div class="reply"><p>A strop never hurts, but it is no need for softwood.</p></div></div><div class="login">Log in to answer</div></body>""",
    # a recipe with a form and a newsletter
    """<body><header><div class="logo"><a href=/>Good plates</a></div><form><input><button>Search</button></form></header><article><h1>@@Lentil soup</h1><p>@@Serves four</p><ul><li>@@200 g lentils</li><li>@@1 onion</li><li>@@2 carrots</li></ul>
<ol><li>@@Chop the onion and the carrots and fry them until they are soft.</li><li>@@Add the lentils and a litre of water and boil for half an hour.</li></ol><form class="rate"><label>Rate this dish</label><input></form><div class="newsletter"><h4>Never miss a dish</h4><p>Get our best dishes in your mail every Friday morning.</p></div>
<p>@@Eat it hot.</p></article><section class="comments"><h3>3 comments</h3><p>Lovely, I made it twice this week and added some bacon to it.</p></section></body>""",
    # a list of links only around one short notice of text
    """<body><ul><li><a href=1>Books</a></li><li><a href=2>Maps</a></li><li><a href=3>Prints</a></li><li><a href=4>Contact</a></li></ul><p>@@We are a small shop for old books, maps and prints in the upper town, open from ten to six on weekdays.</p>
<p>@@Closed on Mondays.</p><p>@@If you look for a certain book, write to us and we will search for it in our stock of some twenty thousand volumes.</p><ul><li><a href=5>Terms of trade</a></li><li><a href=6>Imprint</a></li></ul><p>Visitors so far: 20314</p></body>""",
    # a long article with links in its text and notes
    """<body><div role="banner"><a href=/>Encyclopedia</a></div><div role="navigation"><a href=r>Random page</a> <a href=n>Recent changes</a></div><p>From the encyclopedia that anyone can edit</p><main><h1>@@Basalt</h1><p>@@Basalt is a dark <a href=a>volcanic rock</a> formed from the rapid cooling of <a href=b>lava</a> rich in <a href=c>magnesium</a> and iron.</p>
<p>@@More than nine tenths of all volcanic rock on Earth is basalt.</p><h2>@@Uses</h2><p>@@It is used in construction, for cobblestones and for statues; heated and drawn it gives a wool that insulates.</p><dl><dt>@@Colour</dt><dd>@@grey to black</dd></dl>
<div class="toolbar"><a href=e>Edit</a> <a href=h>History</a></div></main><div role="contentinfo">Text may be used under the licence of the site. See the terms of use for what that means in detail.</div></body>""",
    # a shop's page of a product
    """<body><nav class="breadcrumbs"><a href=/>Home</a> &gt; <a href=/t>Tools</a></nav><div>Free shipping for all orders over fifty until the end of this week</div><main><h1>@@Hand drill</h1><p>@@A drill with two gears for holes of up to eight millimetres in wood.</p><p>@@Weight: 900 g</p><div class="recommended"><h3>Others bought</h3><p><a href=1>Set of bits</a></p><p>A set of bits of all sizes, made for this drill and for most others.</p></div></main>
<div class="widget"><h3>Basket</h3><p>Your basket is empty. Put something into it to see it here.</p></div><footer><ul><li><a href=a>Shipping</a></li><li><a href=b>Returns</a></li></ul></footer></body>""",
    # divs only, with long text, a teaser list and a box of links
    """<body><div><a href=/>Start</a> <a href=/k>Culture</a> <a href=/l>Local</a></div><div><div>@@Choir sings in the station hall</div><div>@@Some two hundred people stopped on their way home on Friday when the choir of the railway workers sang in the station hall.</div>
<div>@@The choir is a hundred years old this year and has planned twelve such evenings in stations along the line.</div><div>@@The next one is in June.</div></div><div><a href=1>Read also: the new time table of the line, and what it changes for you</a></div><div><a href=2>Most read: a fox in the town hall</a></div><div><a href=p>Privacy</a> <a href=i>Imprint</a></div><div>All rights reserved</div></body>""",
    # a page of letters with captions and a notice, no article
    """<body><div class="menu"><a href=1>Letters</a><a href=2>People</a></div><div class="notice">This archive will be closed for work on Sunday from two to four in the morning.</div><h1>@@A letter from the coast, 1871</h1><p>@@Dear sister, we came here on Monday after a day and a night in the coach, and I have not slept since for the noise of the sea.</p>
<p>@@The children are well. The house is small, but there is a garden with a wall, and from the upper window one sees the ships come in.</p><p>@@Write soon.</p><p>@@Your brother, and all of us here who think of you and hope that you will come in the summer as you said.</p></body>""",
    # a press release in an article with a header and footer of its own
    """<body><div id="header"><a href=/>Water board</a></div><article><header><p>Press office, phone 555</p></header><h1>@@Water prices stay as they are</h1><p>@@The board has decided not to raise the price of water in the coming year.</p><p>@@The decision holds for all households.</p><footer><p>The water board serves nine towns in the valley and has its seat in the old brewery.</p></footer></article><div class="social"><a href=1>Follow us</a></div></body>""",
    # a travel page, menus as plain lists, a hidden block and a long menu of words
    """<body><div><ul><li><a href=1>Towns</a></li><li><a href=2>Lakes</a></li><li><a href=3>Walks</a></li></ul></div><p hidden>Loading the map, please wait a moment until it has come up</p><h1>@@Around the lake in a day</h1><p>@@The path starts at the landing place and follows the shore to the east, through reeds at first and then through a wood of old beeches.</p><p>@@Take water with you.</p>
<p>@@After two hours you come to the village, where the inn by the church is open from noon; the way back on the north side is shorter, but steep.</p><h3>@@Good to know</h3><p>@@Dogs must be kept on a lead.</p><p>@@The boat goes back every hour until six, and on days of wind not at all, so ask before you set out.</p><ul><li><a href=x>Other walks</a></li><li><a href=y>Where to stay</a></li></ul></body>""",
    # pages of news in brief without marks, with a box of words between
    """<body><p><a href=/>Index</a></p><h2>@@News in brief</h2><p>@@The library is open again after the repairs to its roof, which took all of the autumn and most of the winter.</p><p>@@The swimming pool is not, as a pump has failed; the town hopes for the end of the month.</p><p><a href=1>More news</a></p><p><a href=2>Older news</a></p><p>Seen 312 times</p></body>""",
)
