"""Pages written by hand, apart from the made-up ones that the labeller learns from: (html, article)."""

PAGES = [
    # No block-level element at all.
    ("just   text &amp; more", "just text & more"),
    ("A note with <b>bold</b> words<br>and a <a href=x>link</a>.", "A note with bold words and a link."),
    # A listing of code inside the article.
    (
        "<body><nav><a href=/>Home</a> <a href=/a>About</a></nav><article><h1>Reading a file in one go</h1><p>Here is how to read a whole file at once, without a loop.</p>"
        "<pre>with open(path) as f:\n    text = f.read()</pre><p>It closes the file at the end of the block, even if an error occurs.</p></article><footer>&copy; 2023 Notes</footer></body>",
        ["Reading a file in one go", "Here is how to read a whole file at once, without a loop.", "with open(path) as f: text = f.read()", "It closes the file at the end of the block, even if an error occurs."],
    ),
    # The title stands before the box of the text.
    (
        "<body><header class=site-header><a href=/>Mountain Diary</a></header><h2 class=entry-title>A walk to the upper lake</h2><div class=entry-content><p>We left the hut before sunrise and took the path along the stream.</p>"
        "<p>By noon the fog had lifted, and the lake lay before us.</p></div><div id=comments><h3>2 comments</h3><p>Lovely pictures!</p></div><footer><p>Copyright Mountain Diary</p></footer></body>",
        ["A walk to the upper lake", "We left the hut before sunrise and took the path along the stream.", "By noon the fog had lifted, and the lake lay before us."],
    ),
    # Three columns of a table.
    (
        "<table width=100%><tr><td><ul><li><a href=1>News</a></li><li><a href=2>Sport</a></li></ul></td><td class=content><h1>Council votes on the new bridge</h1><p>The council voted on Tuesday to build a second bridge across the river.</p>"
        "<p>Work is to begin in spring and will last about two years.</p></td><td class=ad>Sponsored: buy our boots and walk on clouds</td></tr></table>",
        ["Council votes on the new bridge", "The council voted on Tuesday to build a second bridge across the river.", "Work is to begin in spring and will last about two years."],
    ),
    # Definition lists, figures and deeper headings.
    (
        "<body><div id=nav><a href=/>Start</a> | <a href=/b>Glossary</a></div><main><h1>Words of the sailor</h1><p>Some words are only heard at sea.</p><h3>On deck</h3><dl><dt>Bow</dt><dd>The front part of the ship.</dd><dt>Stern</dt><dd>The rear part of the ship.</dd></dl>"
        "<figure><img src=a.png><figcaption>A ship in the harbour of Brest.</figcaption></figure></main><div class=footer>Imprint</div></body>",
        ["Words of the sailor", "Some words are only heard at sea.", "On deck", "Bow", "The front part of the ship.", "Stern", "The rear part of the ship.", "A ship in the harbour of Brest."],
    ),
    # No class and no id anywhere.
    (
        "<html><body><header><a href=/>The Paper</a></header><nav><a href=1>Politics</a><a href=2>Culture</a></nav><main><h1>A quiet year for the theatre</h1><p>Fewer plays were shown than in any year since the war.</p><p>The director hopes for better times.</p></main>"
        "<aside><h4>Most read</h4><ul><li><a href=9>Storm warning</a></li></ul></aside><footer>All rights reserved</footer></body></html>",
        ["A quiet year for the theatre", "Fewer plays were shown than in any year since the war.", "The director hopes for better times."],
    ),
    # Notices and a newsletter form inside the text.
    (
        "<body><div class=cookie-banner>We use cookies. <button>Accept</button></div><div class=post><h1>Baking bread at home</h1><p>You need flour, water, salt and a little patience.</p><div class='newsletter-signup'><p>Subscribe to our newsletter</p><form><input name=e><button>Sign up</button></form></div>"
        "<p>Let the dough rest for a night in a cool place.</p><ol><li>Knead the dough.</li><li>Heat the oven.</li></ol></div></body>",
        ["Baking bread at home", "You need flour, water, salt and a little patience.", "Let the dough rest for a night in a cool place.", "Knead the dough.", "Heat the oven."],
    ),
    # Other languages, references and broken nesting.
    (
        "<body><div class=menu><a href=/>Startseite</a></div><div class=article-body><h1>Die Stra&szlig;e am Flu&szlig;</h1><p>Im Fr&uuml;hling bl&uuml;hen dort die B&auml;ume.<p>Abends gehen viele Leute spazieren.<blockquote>Ein sch&ouml;ner Ort.</blockquote></div><div class=footer>Impressum</div>",
        ["Die Straße am Fluß", "Im Frühling blühen dort die Bäume.", "Abends gehen viele Leute spazieren.", "Ein schöner Ort."],
    ),
    # Replies of readers, adverts between paragraphs, share links.
    (
        "<article class=story><h1>Why owls fly silently</h1><ul class=social-share><li><a href=f>Share</a></li><li><a href=t>Post</a></li></ul><p>The edges of their feathers break up the air.</p><div class=advert>Advertisement: cheap flights</div><p>So a mouse hears nothing until it is too late.</p></article>"
        "<section class=comments><h3>Comments</h3><article class=comment><p>I heard one last night.</p></article><article class=comment><p>Great read, thanks.</p></article></section>",
        ["Why owls fly silently", "The edges of their feathers break up the air.", "So a mouse hears nothing until it is too late."],
    ),
    # A text of one paragraph between much else.
    (
        "<body><div class=topbar>Call us now</div><nav class=breadcrumb><a href=/>Home</a> &gt; <a href=/n>News</a></nav><article><p>The museum stays closed on Monday because of repairs to the roof.</p></article><div class=related><h4>Related</h4><ul><li><a href=1>Opening hours</a></li><li><a href=2>Tickets</a></li></ul></div><footer><p>Contact</p><p>Privacy</p></footer></body>",
        ["The museum stays closed on Monday because of repairs to the roof."],
    ),
    # A table of data inside the article.
    (
        "<body><header><h2>Weather Weekly</h2></header><article><h1>Rain in three cities</h1><p>The table shows the rain of a week in millimetres.</p><table><tr><th>City</th><th>Rain</th></tr><tr><td>Lyon</td><td>12</td></tr></table><p>Lyon had the most.</p></article><aside class=sidebar>Popular this week</aside></body>",
        ["Rain in three cities", "The table shows the rain of a week in millimetres.", "City", "Rain", "Lyon", "12", "Lyon had the most."],
    ),
]


def article(text):
    return text if isinstance(text, str) else "\n\n".join(text)
