"""The labelled pages that the block classifier of operator 3 is grown from, written for it.

A block of text that starts with + belongs to the main text, one that starts with - does not.
"""

PAGES = (
    # a newspaper's article with everything around it
    """<html><body><header class="masthead"><h1>-The Harbour Post</h1><p>-News from the coast since 1921, every day of the week</p></header>
<nav><ul><li><a href="/">-Home</a></li><li><a href="/local">-Local</a></li><li><a href="/sport">-Sport and leisure</a></li></ul></nav>
<div class="cookie-notice"><p>-We and our partners store cookies on your device to measure how this site is used. You may change your choice at any time in the settings.</p></div>
<article><header><h1>+Old lighthouse to open its doors again</h1><p class="byline">+By Mara Lindqvist</p></header>
<p>+After eleven years behind scaffolding the lighthouse on the northern pier will open to visitors in spring, the harbour office said on Tuesday. The lamp room and the keeper's flat have been restored with
the help of <a href="/volunteers">+two hundred volunteers</a>, most of them from the town.</p><p>+It was worth it.</p><div class="ad">-Sail away for less: cabins from forty nine, book today and bring a friend for free</div>
<p>+"We found his logbook under the floor," said the architect, who had not expected to find anything at all. The book lists every ship that passed between 1888 and 1903, together with the weather and the
price of herring.</p><h2>+What it cost</h2><p>+The work cost four million, of which the state paid half. A ticket will be six.</p><ul><li>+Open from April to October</li><li>+Closed on Mondays</li></ul>
<aside><h3>-Related stories</h3><p>-The pier that would not stand: a short history of the northern harbour and of those who built it twice</p></aside>
<form><label>-E-mail</label><input><button>-Tell me</button><p>-We write once, on the day when tickets go on sale</p></form><p>+Visitors will have to climb 211 steps.</p></article>
<section id="comments"><h2>-Comments</h2><article><p>-I went there as a child with my grandfather and he told me the very same story about the herring, only with more herring in it.</p></article><p>-Nice.</p></section>
<footer><p>-All rights reserved. The Harbour Post is a member of the coastal press council and follows its code.</p><a href="/imprint">-Imprint</a></footer></body></html>""",
    # a blog of plain divisions
    """<body><div id="page"><div id="header"><div>-Notes from the shed</div><div>-on wood, tools and patience</div></div><div id="menu"><a href="/">-Blog</a> <a href="/about">-About</a> <a href="/rss">-Feed</a></div>
<div id="content"><h2>+Sharpening a plane iron</h2><div>+A plane iron is sharp when it shaves the end grain of pine without tearing it. Everything else is decoration. I use two stones and a piece of leather, and I have
never needed the jig that I was given for my birthday.</div><div>+Flatten the back first.</div><div>+Only the last few millimetres matter, but these must be as flat as the stone itself, so take your time and look at the reflection of the window in the steel.
When the line of the window frame does not bend any more you are done.</div><div>+Then turn to the bevel. Twenty five degrees on the grinder, thirty on the stone, and count your strokes.</div></div>
<div class="sidebar"><div>-About me</div><div>-I am a retired teacher who builds chairs that nobody asked for and writes about them here, usually on Sundays when it rains.</div><ul><li><a href="/2021">-March 2021</a></li><li><a href="/2020">-All of 2020</a></li></ul></div>
<div class="footer">-Powered by patience, written in a text editor, hosted on a computer under the stairs</div></div></body>""",
    # an encyclopaedia with many links inside its text
    """<body><div class="nav"><ul><li><a href="/r">-Random page</a></li><li><a href="/c">-Recent changes</a></li><li><a href="/d">-Donate</a></li></ul></div><main><h1>+Peat</h1>
<p>+Peat is an accumulation of partly decayed <a href="v">+vegetation</a> that forms in <a href="w">+wetlands</a> such as <a href="b">+bogs</a>, <a href="m">+mires</a> and <a href="f">+fens</a>, where water keeps out the oxygen that decay needs.</p>
<div class="sponsored">-Garden earth without peat, delivered to your door</div><p>+It has been cut and dried as a fuel since <a href="a">+antiquity</a>.</p><h2>+Formation</h2><p>+A layer of one metre takes about a thousand years to grow. Where the ground is <a href="p">+frozen</a> most of the year it grows even more slowly.</p>
<table><tr><th>+Country</th><th>+Area</th></tr><tr><td>+Finland</td><td>+83,000</td></tr></table><h2>+See also</h2><p>+Lignite, a brown coal that peat may become under pressure.</p></main>
<footer><p>-Text is available under a free licence; additional terms may apply.</p></footer></body>""",
    # a forum: one post, then what readers say
    """<body><header>-Board of the radio amateurs</header><nav><a href="a">-Index</a> <a href="b">-Search</a> <a href="c">-Members</a></nav><article class="post"><h1>+Noise on forty metres after sunset</h1>
<p>+Every evening at about seven the band fills with a buzz that starts near 7.05 and wanders up. I have switched off everything in my own house, and it stays.</p><p>+Any ideas?</p></article>
<div class="comments"><h3>-4 replies</h3><div class="comment"><p>-It is almost certainly the power supply of somebody's garden lights. Walk around the block with a portable set and you will find the house within ten minutes, as I did.</p></div>
<div class="comment"><p>-Same here. Mine was the charger of a scooter, which had lost its filter, and the neighbour was happy to replace it when I showed him what it did to his own television.</p></div>
<div class="comment"><p>-Have you asked the regulator? They came to us with a van.</p></div><div class="comment"><p>-Thanks all</p></div></div><form><label>-Your reply</label><p>-Please be kind and stay with the subject</p><button>-Send</button></form></body>""",
    # a recipe in French with lists
    """<body><div class="wrapper"><div class="topbar"><a href="/">-Accueil</a><a href="/r">-Recettes</a><a href="/m">-Mon compte</a></div><div class="recipe"><h1>+Soupe à l'oignon</h1><p>+Pour quatre personnes, une heure.</p>
<h2>+Ingrédients</h2><ul><li>+Six gros oignons</li><li>+Un litre de bouillon de bœuf</li><li>+Du pain rassis</li><li>+Sel</li></ul><h2>+Préparation</h2>
<ol><li>+Émincez les oignons et faites-les fondre très doucement dans le beurre, au moins quarante minutes, jusqu'à ce qu'ils soient bruns et doux.</li><li>+Mouillez avec le bouillon et laissez cuire encore vingt minutes.</li><li>+Servez.</li></ol>
<p>+Le fromage se met à la fin, sur le pain, et le tout passe sous le gril jusqu'à ce que la surface chante.</p></div><div class="newsletter"><p>-Recevez chaque semaine trois idées simples pour vos dîners, sans publicité.</p><input><button>-Je m'abonne</button></div>
<div class="related"><h3>-À lire aussi</h3><ul><li><a href="t">-Tarte aux poireaux</a></li><li><a href="g">-Gratin dauphinois</a></li></ul></div></div></body>""",
    # a short notice
    """<body><nav><ul><li><a href="1">-Start</a></li><li><a href="2">-Verein</a></li></ul></nav><article><h1>+Hallenbad geschlossen</h1><p>+Das Hallenbad bleibt am Freitag zu.</p></article><footer>-Stadtwerke, Postfach 12, Telefon 5550</footer></body>""",
    # a page that is little more than its text
    """<body><h1>+To whoever finds this</h1><p>+I have left the key with the woman at the bakery. She knows about the cat. Please water the lemon tree, which stands in the yard behind the house, but not on days when it rains.</p><div><p>+And if it is the cat who finds this: no.</p></div><p>+Thank you, and good night.</p></body>""",
    """<body><p>+Two short lines are all there is.</p><p>+This is the other.</p></body>""",
    # a handbook's chapter with the table of contents at its side
    """<body><form id="whole"><div class="layout with-sidebar"><div class="toc"><ul><li><a href="1">-1 Getting started</a></li><li><a href="2">-2 Configuration</a></li><li><a href="3">-3 Backups and restore</a></li><li><a href="4">-4 Troubleshooting</a></li></ul></div>
<div class="chapter"><h1>+Backups and restore</h1><p>+The service writes a snapshot of its state every hour. Snapshots are kept for a week, and the last one of each day for a year. Nothing has to be set up for that.</p><pre>+restore --from 2024-03-01</pre>
<p>+Run the command on a machine that has no state of its own.</p><div class="widget"><label>-Version</label><button>-2.4</button></div><p>+It refuses to overwrite anything, asks for the key that you were given at installation, and then copies the snapshot in the background; the progress is shown in the
<a href="log">+log</a>, one line a minute.</p><h2>+When it fails</h2><p>+Try again. If the second attempt fails as well, the snapshot is damaged and you need the one before.</p></div><div class="prevnext"><a href="2">-Previous: Configuration</a> <a href="4">-Next: Troubleshooting</a></div></div></form>
<div class="legal">-Trademarks belong to their owners</div></body>""",
    # a magazine that puts teasers below its story
    """<body><div id="top"><p>-Subscribe now and read the first three months for the price of one, cancel whenever you like</p></div><div id="story"><h1>+The man who counts swifts</h1><p>+For thirty summers Anton Reiter has climbed the same tower at dawn, with a
stool, a thermos and a notebook. He counts swifts. In the first year there were four hundred; last year there were thirty one.</p><p>+"They are never late," he says.</p><p>+The birds leave for Africa in the first week of August and come back in the last days of
April, and in between they hardly touch anything that stands on the ground. They sleep in the air, in circles, two thousand metres up.</p><p>+His notebooks fill a shelf. The university has asked for them twice, and twice he has said that they are not finished.</p>
<div class="share"><a href="f">-Share</a> <a href="p">-Print</a></div><blockquote>+One does not count to know the number.</blockquote><p>+Then he packs the stool.</p></div><div id="more"><h3>-More from this issue</h3><div><a href="1">-Why the river runs backwards</a><p>-Twice a day the tide turns the lower river round, and a whole town lives by it.</p></div>
<div><a href="2">-A kitchen for the moon</a><p>-What astronauts eat, and who has to cook it for them.</p></div></div><div id="bottom"><a href="t">-Terms</a> <a href="p">-Privacy</a> -A publication of the Field Press</div></body>""",
    # a shop's product page
    """<body><header><p>-Free delivery on orders over fifty, and thirty days to change your mind</p></header><nav><a href="1">-Tents</a><a href="2">-Stoves</a><a href="3">-Sale</a></nav><main><h1>+Two-person tent Fjord</h1><p>+A light tent for two with an entrance on each side. The poles are marked
by colour, so that it can be put up in the dark, and the floor holds out a night of steady rain.</p><ul><li>+Weight 1.9 kg</li><li>+Height 105 cm</li></ul><div class="share"><a href="f">-Share</a></div></main>
<section class="reviews comments"><h2>-Reviews</h2><p>-Used it for two weeks in the mountains and it kept us dry, though the pegs bend if you look at them. Would buy again for the weight alone.</p></section><footer><p>-Customer service is open from nine to five on weekdays</p></footer></body>""",
    # a press release in a table layout
    """<body><table><tr><td><a href="h">-Inicio</a></td><td><a href="e">-Empresa</a></td><td><a href="c">-Contacto</a></td></tr></table><div><h1>+Nueva línea de tranvía</h1><p>+La ciudad abrirá en otoño una línea de tranvía de doce kilómetros que une el puerto con la
universidad. Las obras duraron tres años y costaron menos de lo previsto.</p><p>+Habrá un tren cada seis minutos.</p><p>+El alcalde dijo que la línea quitará de las calles ocho mil coches al día, y que la siguiente, hacia el hospital, ya está dibujada.</p></div>
<div>-Oficina de prensa, plaza Mayor 1</div></body>""",
    # pages with long text where no main text is
    """<body><nav><p>-Choose a region below to see the stores near you and the hours at which they open on weekdays and on Sundays</p><a href="n">-North</a></nav><article><h1>+Recall of the blue kettle</h1><p>+Kettles of the series B2 sold before May may leak at the handle.</p>
<p>+Return them.</p><div class="advert"><p>-Tea tastes better from a pot. See ours, all eleven of them.</p></div><p>+You will get a new one or your money back in any of our stores, also without the receipt, until the end of the year.</p></article><aside><p>-Our spring catalogue is here: eighty pages of things for the kitchen, from knives that stay sharp to pans that
do not stick, with recipes by people who cook for a living and prices that hold until June.</p></aside><footer><p>-The company is entered in the register of the district court under number 2231. Managing directors are listed there together with the address
to which legal notices must be sent. Prices include tax.</p><p>-Photographs may show accessories that are not included</p></footer></body>""",
    """<body><div class="banner"><p>-We have changed our terms of use. By using this site after the first of the month you agree to the new ones, which you can read by following the link below.</p><a href="t">-Terms</a></div><div class="main-column"><div class="entry"><h1>+On losing at chess</h1>
<p>+My daughter beat me for the first time on a train between two tunnels. I had seen it coming for about a year, the way one sees weather.</p><p>+She did not gloat. She put the pieces back, all of them, in their places, and asked whether I wanted white.</p><p>+I did.</p>
<p>+There is a particular silence after a lost game in which one goes through the moves and finds the place where it could have gone otherwise, and then one finds that it could not.</p></div></div><div class="pagination"><a href="1">-Older</a><a href="2">-Newer</a></div></body>""",
    """<body><div>-Loading</div><div><a href="x">-Skip to content</a></div><div><div><h1>+Minutes of the meeting</h1><div>+Present were nine members; two had sent apologies.</div><div>+The treasurer reported that the roof had been paid for and that the account held enough for the winter, unless the
heating broke again.</div><div>+Agreed.</div><div>+The next meeting is on the second Thursday of March at the usual place, and the secretary was asked to bring the keys and the old plans of the hall.</div></div></div><div>-Print this page</div></body>""",
    # long paragraphs next to what does not belong to them
    """<body><nav><ul><li><a href="a">-Archive</a></li><li><a href="b">-Authors</a></li></ul></nav><div class="ad">-Learn a language in the time it takes to drink your coffee.</div><article><h1>+The ferry that was late for forty years</h1>
<p>+When the ferry company printed its first timetable, somebody wrote down the crossing as eleven minutes, because eleven fitted the column. The crossing takes fourteen. For forty years the boat left on time and arrived three minutes late, and for
forty years the people on the far side set their clocks by it, so that everything over there, the school, the bakery and the church, ran three minutes behind the rest of the country.</p><form><label>-Search the archive</label><input><button>-Go</button></form><p>+Nobody minded much until the bridge was built, and then it turned
out that two halves of one town disagreed about the time by exactly the length of a song. They held a vote. The far side kept its three minutes by a majority of nine, and the bridge has a line of brass across its middle where, if you step over it, you grow a little younger.</p></article>
<footer>-&copy; ferry.example.org &middot; Printed on the water.</footer></body>""",
    """<body><nav><a href="1">-Front</a> <a href="2">-Contact</a></nav><div class="ad">-Chairs at half the price.</div><article><h1>+Sold out</h1><p>+The concert of the eighth is sold out. Tickets that were ordered and not fetched by noon on the day will be given to those who wait at the door, in
the order in which they came, and the rest of us may listen from the garden, where the windows will be open as long as the weather allows it and the neighbours do.</p></article><footer>-&copy; hall.example.org &middot; A house of the city, and of all who pay for it, whether they like music or not.</footer></body>""",
    """<body><header>-River Cottage Weekly</header><div class="text"><h1>+Eels</h1><p>+An eel is born in a sea that nobody has seen it being born in, swims for three years to a river it does not know, lives there for twenty, and then one autumn night turns silver and goes back. Nobody has
followed one the whole way. They were thought to grow from mud, from dew, and from the hairs of horses, and a young doctor who cut open four hundred of them in search of an answer became famous for something else.</p><p>+We know where they go because that is where the smallest ones are.</p>
<p>+That is all we know, and the nets are emptier every year, so it may be that it is all that we are going to know.</p></div><div class="ad">-Rods, reels and rain: everything must go.</div><footer>-&copy; cottage.example.org &middot; Written by hand.</footer></body>""",
    """<body><nav><a href="1">-Map</a></nav><article><h1>+Closed road</h1><p>+Mill Lane is closed until the fourth.</p><p>+Use the bridge.</p></article><footer>-&copy; parish.example.org &middot; Office hours are on Tuesdays from two to four, and by appointment with the clerk, who lives next door.</footer></body>""",
    # articles no longer than what stands around them
    """<body><nav><ul><li><a href="a">-News</a></li><li><a href="b">-Fares</a></li></ul></nav><div class="ad">-Every second pair of shoes is free until Saturday evening.</div><article><h1>+No trains tonight</h1><p>+Buses leave at ten and at midnight.</p></article><footer>-&copy; trains.example.net &middot; A service of the eastern region and its towns.</footer></body>""",
    """<body><nav><a href="a">-Start</a> <a href="b">-Rooms</a></nav><div class="ad">-Two nights for one, if you come by bicycle.</div><article><h1>+Season's end</h1><p>+We close on the last day of October.</p><p>+See you in May.</p></article><footer>-&copy; inn.example.net &middot; Third house on the left after the chapel and the pond.</footer></body>""",
    """<body><nav><ul><li><a href="a">-Blog</a></li></ul></nav><div class="ad">-Seeds for every balcony, now in larger bags.</div><article><h1>+Still here</h1><p>+More soon.</p></article><footer>-&copy; a.example.net &middot; Made with care and far too little sleep.</footer></body>""",
    """<body><nav><a href="a">-Team</a></nav><div class="ad">-Your roof repaired in a day.</div><article><h1>+Result</h1><p>+We lost by two, and deserved it.</p></article><footer>-&copy; club.example.net &middot; Training is on Wednesdays behind the school.</footer></body>""",
    # long stories with long texts around them
    """<body><header><h2>-The Quarterly</h2><p>-A magazine of long stories. It appears when the stories are done, which is about four times a year, and is sent by post to those who ask for it and in this form to everybody else; there is no shorter version of it, and there never was one, whatever you may have heard.</p></header>
<nav><a href="1">-Issues</a><a href="2">-Writers</a></nav><div class="cookie-notice"><p>-This site stores a number on your device that tells us nothing about you except that you have been here before. If you do not want that, close this page, or use the settings of your browser to refuse the number, in which case you will see this notice on each page, for which we are sorry, as it is long.</p></div>
<article><h1>+The last weaver</h1><p>+There were nineteen looms in the village when Ida was born, and the noise of them was so much a part of the place that people who came from elsewhere asked what it was, and those who lived there had to stop and listen before they knew. Today there is one, and it stands in her front room, where it leaves space for a chair and a stove.</p>
<p>+She works from six to eleven. In the afternoon the light comes from the wrong side, and besides, she says, a person who weaves more than five hours a day begins to see everything in threads, and there is no cure for that but to go out and look at cows, which are the least woven thing she knows of in this world or in any other.</p><p>+Her cloth is grey.</p><div class="ad">-Wool from sheep that have names. From twelve a ball.</div><form><label>-Your address</label><button>-Send me the next one</button></form>
<p>+It goes to a tailor in the city who makes coats of it that last for thirty years, and this, as he likes to say, is the reason why he is poor. He has asked her to teach somebody. Three people came: one stayed for a week, one for a month, and the third, a young man from the coast, stayed until his hands bled and then for another two years, and went home and built a loom of his own.</p>
<aside><p>-In our shop: prints of the photographs in this issue, on heavy paper and in two sizes, signed by the photographer and packed by hand. Orders that reach us before noon leave the same day, and what does not please you may come back within a month, and we will not ask why, although we would of course like to know.</p></aside>
<p>+So there are two looms now, four hundred kilometres apart, and once a month a letter goes each way with a piece of cloth in it, no larger than a hand, and a few words about what is wrong with it.</p><div class="promo"><p>-Give the Quarterly to somebody who has time. The first issue of a gift comes with a card on which we write what you tell us to, by hand and with a pen, up to forty words, in any of five languages, or, if you can't think of anything, a line that we have found to be right on most occasions.</p></div>
<p>+She keeps the pieces in a tin.</p></article><div class="comments"><h3>-Letters</h3><p>-My mother worked one of the nineteen and she told us that on the day when the electric ones came to the town below, the owner of the mill walked up the hill and asked all of them to come down and work for him, and that nobody said a word until he had left, and then they all laughed, and the next spring they all went.</p><p>-Thank you for this one.</p></div>
<footer><p>-The Quarterly is printed on paper from forests that are cut more slowly than they grow, by a printer who has done it for us from the first issue on. Reprints are allowed if you ask, translations are welcome if you are good at them, and the opinions are those of the writers, whose names stand above them for exactly that reason.</p></footer></body>""",
    """<body><div class="sidebar"><p>-The author of these pages has been a surveyor, a baker and for one long winter a keeper of goats, and lives with a family and several clocks in a house that was built for somebody taller. Questions are answered on Sundays, in the order in which they come, and with the care that they deserve, though not always at the length that was hoped for.</p></div>
<div class="text"><h1>+How to read an old map</h1><p>+Begin with the edges. Whoever drew the map knew the middle, since that is where they lived, and the middle tells you what everybody knew; but the edges are where they had to decide what to put down, and it is there that you see how they thought, what they feared, and whom they had asked about the things that they had not been able to see.</p>
<p>+Then look for the scale.</p><p>+If there is none, as is usual before the middle of the sixteenth century, measure the distance between two churches that still stand, and then between two others, and then between a third pair. You will get three scales, and the differences between them are the roads: where the walking was slow the map is long, because it was drawn by people who measured land in days.</p>
<p>+Colours come last. They were put on by others, often by children, in the workshop of the printer, and say more about what was cheap that year than about forests and seas, with one exception, which is the red of the towns, for which there was a tax.</p><p>+And do not trust the monsters. They are copied.</p></div>
<div class="disclaimer"><p>-Nothing on these pages is advice. If you walk into a bog because an old map of this collection shows a road through it, then the bog is not to blame, and neither is the author, who has said more than once that the road was there in the year in which the map was drawn and has not been seen by anybody in the three hundred years that followed.</p></div></body>""",
    # the text comes last
    """<body><div class="banner"><p>-Winter coats are here, in three colours and in every size that people come in.</p></div><nav><a href="1">-All letters</a></nav><article><h1>+Letter from the pass</h1><p>+The road is open again, and so I can tell you that we are well.</p><div class="advertisement">-Skis, sledges and shovels, while they last</div><p>+It snowed for nine days.</p><p>+We had bread for seven, and on the eighth the dog found a way down to the dairy that none of us knew.</p></article></body>""",
    """<body><div id="menu"><a href="1">-Home</a> <a href="2">-Notes</a></div><div class="notice">-The library is closed on the first and the second of May, and the reading room on the third as well.</div><div class="post"><h2>+Found in a returned book</h2><p>+A list: milk, a lamp, forgiveness.</p><p>+On its other side somebody had drawn the plan of a garden with three trees, a pond and no gate, and signed it.</p><p>+We keep it at the desk.</p></div></body>""",
    """<body><div><div class="header">-The Observatory</div><div class="login">-Members see the sky of tonight after they have signed in with their number</div></div><main><h1>+Comet in the west</h1><p>+Look low in the west an hour after sunset, to the left of the bright star. You need no telescope, but a hill helps, and so does a friend who has seen it before.</p><div class="box">+Where: anywhere dark, with a free view to the west.</div><div class="cta widget">-Get the star map</div><p>+It will not come back.</p><div>+Drawings of it are welcome at the desk, on paper, with date and time.</div></main></body>""",
)
