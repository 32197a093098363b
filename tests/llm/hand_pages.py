"""Pages written and labelled by hand, in the manner of common kinds of sites; none comes from the training generator."""

PAGES = [
    (
        """<!doctype html>
<html><head><title>Bridge reopens | The Harbour Post</title><link rel=stylesheet href=a.css></head>
<body class="article-page">
<div id="cookie-banner"><p>We use cookies to improve your visit.</p><button>Accept all</button></div>
<header class="site-header"><a href="/" class="logo">The Harbour Post</a>
<nav><ul><li><a href="/local">Local</a></li><li><a href="/sport">Sport</a></li></ul></nav></header>
<main><article>
<h1>Old bridge reopens after two years</h1>
<p>The stone bridge over the river   opened to traffic on Monday,
two years after a flood damaged its central pier.</p>
<p>&ldquo;We are proud,&rdquo; said the mayor, &amp; the crowd agreed.</p>
<div class="ad-slot">Advertisement: Buy new tyres today!</div>
<p>Work cost four million crowns.</p>
</article></main>
<aside class="related"><h3>Related stories</h3><ul><li><a href="/1">Floods of 2021</a></li><li><a href="/2">Ferry timetable</a></li></ul></aside>
<section id="comments"><h2>2 comments</h2><div class="comment"><b>Ann</b><p>Finally! I was tired of the detour.</p></div></section>
<footer><p>&copy; 2023 The Harbour Post. All rights reserved.</p></footer>
</body></html>""",
        ["Old bridge reopens after two years", "The stone bridge over the river opened to traffic on Monday, two years after a flood damaged its central pier.", "“We are proud,” said the mayor, & the crowd agreed.", "Work cost four million crowns."],
    ),
    (
        """<html><body><div id=wrap>
<div id="topbar"><a href="/login">Log in</a> | <a href="/join">Join</a></div>
<div id="menu"><a href="/">Home</a> <a href="/about">About</a> <a href="/archive">Archive</a></div>
<div class="post"><h2 class="post-title">Baking rye bread at home</h2>
<div class="entry-content"><p>Rye flour drinks more water than wheat does, so the dough will feel wet.</p>
<h3>What you need</h3><ul><li>500 g rye flour</li><li>400 ml water</li><li>a pinch of salt</li></ul>
<p>Let it rest <em>overnight</em>, then bake it for <b>50 minutes</b>.</p></div>
<div class="share-buttons"><a href="#">Tweet</a><a href="#">Like</a></div></div>
<div id="sidebar"><h4>Popular posts</h4><ul><li><a href="/p1">Sourdough</a></li><li><a href="/p2">Scones</a></li></ul></div>
<div id="footer">Powered by BlogThing. <a href="/privacy">Privacy</a></div>
</div></body></html>""",
        ["Baking rye bread at home", "Rye flour drinks more water than wheat does, so the dough will feel wet.", "What you need", "500 g rye flour", "400 ml water", "a pinch of salt", "Let it rest overnight, then bake it for 50 minutes."],
    ),
    (
        """<!DOCTYPE html><html lang=en><head><title>sort() - Manual</title><script>if (1 < 2) { document.write("<p>no</p>") }</script></head><body>
<nav class="breadcrumbs"><a href="/">Docs</a> &raquo; <a href="/f">Functions</a></nav>
<main role="main"><h1>sort()</h1><p>Sorts the items of a list in place and returns nothing.</p>
<pre>numbers = [3, 1, 2]
numbers.sort()</pre>
<h2>Parameters</h2><table><tr><th>Name</th><th>Meaning</th></tr><tr><td>key</td><td>function of one argument</td></tr></table>
<blockquote>Sorting is stable since version two.</blockquote></main>
<form action="/feedback"><label>Was this page helpful?</label><input name=v><button>Send</button></form>
<footer class="footer"><a href="/terms">Terms</a></footer></body></html>""",
        ["sort()", "Sorts the items of a list in place and returns nothing.", "numbers = [3, 1, 2] numbers.sort()", "Parameters", "Name", "Meaning", "key", "function of one argument", "Sorting is stable since version two."],
    ),
    (
        """<HTML><BODY BGCOLOR=white><CENTER><TABLE WIDTH=600><TR><TD CLASS="nav"><A HREF="/">Home</A><BR><A HREF="/l">Links</A></TD>
<TD><H1>Notes on the moths of the valley</H1><P>The emperor moth flies in April, when nights are still cold and the heather has not yet flowered.
<P>Its larvae feed on bramble, and later on willow; they are easy to find on low branches.
<P>Please write down the date of every sighting.</TD></TR></TABLE></CENTER></BODY></HTML>""",
        ["Notes on the moths of the valley", "The emperor moth flies in April, when nights are still cold and the heather has not yet flowered.", "Its larvae feed on bramble, and later on willow; they are easy to find on low branches.", "Please write down the date of every sighting."],
    ),
    (
        """<html lang="fr"><head><meta charset=utf-8><title>Le marché</title></head><body>
<header><h1><a href="/">La Gazette du Sud</a></h1><p class="tagline">L'information près de vous</p></header>
<div class="newsletter"><p>Inscrivez-vous à notre lettre du matin</p><form><input type=email><button>OK</button></form></div>
<article class="story"><header><h1>Le marché couvert change d'horaires</h1></header>
<p>À partir de lundi, le marché ouvrira à six heures.</p><figure><img src=m.jpg><figcaption>Le marché, vu de la place.</figcaption></figure>
<p>Les commerçants ont voté le mois dernier&nbsp;; la mairie a suivi leur avis.</p></article>
<div class="recommended"><h3>À lire aussi</h3><a href="/x">Une fête au port</a></div>
<footer>Mentions légales &middot; Contact</footer></body></html>""",
        ["Le marché couvert change d'horaires", "À partir de lundi, le marché ouvrira à six heures.", "Le marché, vu de la place.", "Les commerçants ont voté le mois dernier ; la mairie a suivi leur avis."],
    ),
    (
        """<html><body><nav><a href=/>Shop</a><a href=/cart>Cart (0)</a></nav><div class="promo-banner">Free delivery this week only!</div>
<div class="product"><h1>Walking boots, brown</h1><p>Made of full-grain leather with a rubber sole, these boots suit wet paths and long days.</p>
<h2>Care</h2><p>Brush off dry mud and treat the leather with wax twice a year.</p></div>
<div id="reviews"><h2>Customer reviews</h2><p>Great boots, they kept my feet dry.</p><p>Too narrow for me.</p></div>
<div class="footer-links"><a href=/r>Returns</a> <a href=/s>Size guide</a></div></body></html>""",
        ["Walking boots, brown", "Made of full-grain leather with a rubber sole, these boots suit wet paths and long days.", "Care", "Brush off dry mud and treat the leather with wax twice a year."],
    ),
    (
        """<!DOCTYPE html><html><body><header id="masthead"><div class="site-title">Freie Enzyklopädie</div></header>
<div id="content" class="body"><h1>Ammersee</h1><p>Der <b>Ammersee</b> ist ein See in Oberbayern. Er ist der drittgr&ouml;&szlig;te See des Landes.</p>
<h2>Geschichte</h2><p>Der See entstand in der letzten Eiszeit, als ein Gletscher das Becken ausschürfte.</p>
<ol><li>Erste Siedlungen am Ufer</li><li>Fischerei im Mittelalter</li></ol></div>
<div id="sidebar-nav"><ul><li><a href="/a">Hauptseite</a></li><li><a href="/b">Zufällige Seite</a></li></ul></div>
<div id="footer"><p>Der Text ist unter einer freien Lizenz verfügbar.</p></div></body></html>""",
        ["Ammersee", "Der Ammersee ist ein See in Oberbayern. Er ist der drittgrößte See des Landes.", "Geschichte", "Der See entstand in der letzten Eiszeit, als ein Gletscher das Becken ausschürfte.", "Erste Siedlungen am Ufer", "Fischerei im Mittelalter"],
    ),
    (
        """<html><body><article><p>Only a short note today<p>It has two unclosed paragraphs, an <i>open italic
and <b>bold text that is closed</b> &mdash; the rest follows.<div class="notice">This site will be down on Sunday.</div></article></body>""",
        ["Only a short note today", "It has two unclosed paragraphs, an open italic and bold text that is closed — the rest follows."],
    ),
    (
        """<html><body><div class="header"><ul class="menu"><li><a href=/>Start</a></li><li><a href=/team>Team</a></li></ul></div>
<main><section><h2>Our laboratory</h2><p>We study how seabirds find their way home over open water, and how the wind changes their routes.</p></section>
<section><h2>Open positions</h2><p>There is one position for a doctoral student from autumn.</p><p>Write to lab@example.org, please.</p></section></main>
<section class="subscribe"><p>Subscribe to our news</p><input><button>Go</button></section><footer><ul><li><a href=/imprint>Imprint</a></li></ul></footer></body></html>""",
        ["Our laboratory", "We study how seabirds find their way home over open water, and how the wind changes their routes.", "Open positions", "There is one position for a doctoral student from autumn.", "Write to lab@example.org, please."],
    ),
    (
        """<html><body><div class="alert">Your browser is old.</div><article><h1>Cronaca di un viaggio</h1>
<p>Siamo partiti all'alba, con lo zaino leggero e una carta del 1950.</p><aside class="advert"><p>Offerta: scarpe a met&agrave; prezzo</p></aside>
<p>Dopo tre ore il sentiero &egrave; sparito sotto la neve.<br>Siamo tornati indietro.</p></article>
<div class="discussion"><ol><li><p>Bel racconto!</p></li><li><p>Anche noi ci siamo persi l&igrave;.</p></li></ol></div></body></html>""",
        ["Cronaca di un viaggio", "Siamo partiti all'alba, con lo zaino leggero e una carta del 1950.", "Dopo tre ore il sentiero è sparito sotto la neve. Siamo tornati indietro."],
    ),
]
