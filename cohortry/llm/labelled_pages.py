"""Small labelled pages. What stands between ⟦ and ⟧ is main text."""

PAGES = [
    '<html lang="en"><head><title>River walks</title><style>p{margin:0}</style></head><body><header><a href="/">Country Notes</a> <p>News from the fields</p></header>'
    '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">Walks</a></li><li><a href="/c">About us</a></li></ul></nav>'
    '<div class="ad">Buy two boots and pay for one this week only</div>'
    '<article><h1>⟦River walks⟧</h1><p>⟦The path follows the water for two miles and then climbs to the old mill.⟧</p>'
    '<p>⟦Bring a map; the signs near the <a href="/ford">ford</a> are missing.⟧</p><ul><li>⟦Start at the bridge.⟧</li><li>⟦Turn left at the church.⟧</li></ul><p>⟦Done.⟧</p></article>'
    '<aside><h2>Most read</h2><ul><li><a href="/1">Ten hills</a></li><li><a href="/2">Tea rooms</a></li></ul></aside>'
    '<footer>&copy; Country Notes &middot; <a href="/legal">Legal</a></footer></body></html>',
    '<html lang="de"><body><div id="header"><p>Tageblatt</p></div><div class="menu"><a href="/">Start</a> <a href="/sport">Sport</a> <a href="/kultur">Kultur</a></div>'
    '<div class="cookie-notice">Wir verwenden Cookies. <button>Annehmen</button></div>'
    '<div id="content"><h1>⟦Der neue Markt⟧</h1><p>⟦Am Morgen standen die Händler schon vor der Halle.⟧</p><p>⟦Viele kamen aus den Dörfern.⟧<br>⟦Andere aus der Stadt.⟧</p>'
    '<blockquote>⟦Wir haben lange gewartet.⟧</blockquote></div>'
    '<div class="sidebar"><p>Wetter: heiter</p><ul><li><a href="/x">Archiv</a></li></ul></div>'
    '<section id="comments"><h3>Kommentare</h3><p>Das ist ja schön.</p><p>Ich war auch da.</p></section><div id="footer">Impressum</div></body></html>',
    '<html lang="fr"><body><nav><a href="/">Accueil</a><a href="/r">Recettes</a></nav><main><h1>⟦La soupe du soir⟧</h1><p>⟦Faites revenir les oignons puis ajoutez l\'eau.⟧</p>'
    '<div class="advert"><p>Vos casseroles à moitié prix, livraison rapide.</p></div><p>⟦Laissez cuire une heure à feu doux.⟧</p>'
    '<table><tr><td>⟦sel⟧</td><td>⟦une pincée⟧</td></tr></table></main><form action="/s"><label>Votre adresse</label><input name="m"><button>Envoyer</button></form>'
    '<div class="comments"><ol class="comment-list"><li>Très bon.</li><li>Merci pour la recette.</li></ol></div><footer><p>Mentions légales</p></footer></body></html>',
    '<html lang="es"><body><div class="top-banner">Suscríbase hoy</div><ul class="nav"><li><a href="/">Inicio</a></li><li><a href="/m">Mapas</a></li></ul>'
    '<div class="post"><h2>⟦El camino largo⟧</h2><p>⟦Salimos temprano y llegamos de noche.⟧</p><p>⟦El pueblo dormía.⟧</p><p>⟦Nada más.⟧</p></div>'
    '<div class="share">Compartir <a href="/f">correo</a></div><div class="related"><h3>También</h3><a href="/1">Otro camino</a></div>'
    '<div class="footer"><p>Todos los derechos reservados</p></div></body></html>',
    '<html><body><table><tr><td><a href="/1">One</a></td><td><a href="/2">Two</a></td><td><a href="/3">Three</a></td></tr></table>'
    '<h1>⟦Notes on wood⟧</h1><p>⟦Oak is heavy and lasts.⟧</p><p>⟦Pine is light, and it is cheap as well.⟧</p><pre>⟦oak 0.7 pine 0.5⟧</pre><hr>'
    '<a href="/prev">Back</a> <a href="/next">Next</a></body></html>',
    '<html><body><div class="wrapper"><header role="banner"><h1>Daily Lamp</h1></header><div role="navigation"><a href="/">Front</a><a href="/w">World</a></div>'
    '<div class="notice">This site moves on Monday.</div><div class="entry-content"><p>⟦The lamp was lit at six.⟧</p><h2>⟦Later⟧</h2><p>⟦It went out by itself.⟧</p><p>⟦Nobody saw <em>why</em>.⟧</p></div>'
    '<div class="newsletter"><form><p>Sign up for letters</p></form></div><div class="widget"><p>Tags: lamp, light</p></div></div></body></html>',
    '<html><body><nav><p>Menu</p><p>Home</p></nav><div><p>⟦A plain page without any names still has long sentences in paragraphs, one after the other.⟧</p>'
    '<p>⟦They follow each other until the end of the page is near.⟧</p></div><div><a href="/1">More</a><a href="/2">Even more</a><a href="/3">Contact</a></div></body></html>',
    '<html><body><section class="promo"><h2>Sale</h2><p>Everything must go.</p></section><article class="story"><header><h1>⟦Snow in May⟧</h1><p>Section: weather</p></header>'
    '<p>⟦It fell for an hour.⟧</p><figure><img src="s.png"><figcaption>⟦The square at noon.⟧</figcaption></figure><p>⟦Then the sun came.⟧</p><footer>Filed under weather</footer></article>'
    '<aside><p>Subscribe for more</p></aside><div id="disqus_thread"><p>First!</p></div></body></html>',
]
