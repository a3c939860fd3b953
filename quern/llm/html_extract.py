"""HTML extraction: the contiguous region of a page with the highest score, words positive and tags negative."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache
from html import unescape
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm._common import table

#: A tag ends at the first > outside of a quoted value, which begins after =; a quote elsewhere is an ordinary character.
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)"
    r"|<(?P<raw>script|style|textarea|title|template|iframe|noembed|noframes|xmp)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/)?(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)",
    re.S | re.I,
)
ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
#: An open tag of the key closes an open element of the value, up to the nearest of CLOSED_BY's ends.
P_CLOSERS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
AGAIN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
P_SCOPE = frozenset("article main section div td th li body button blockquote".split())
INLINE_SCOPE = P_CLOSERS | {"li", "td", "th", "body"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset("article main".split())
#: Elements that are no article text by their name, and by their role.
DROPPED = frozenset("nav footer aside form head button select svg canvas audio video object menu dialog math datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
#: Words of a class or id that name such an element, where all other words of it are SHAPE words.
NAMES = frozenset(
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs footer sidebar sidebars aside widget widgets ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promotions banner banners cookie cookies"
    " consent gdpr notice notices notification notifications alert alerts popup modal overlay newsletter subscribe subscription signup login signin search comment comments commentlist disqus respond responses replies discussion"
    " share sharing social related recommended recommendations pagination pager toolbar masthead topbar skip copyright paywall".split()
)
SHAPE = frozenset(
    "a site page post posts entry article articles main body content area block blocks box bar bars button buttons card cards column container wrapper wrap wrapped section list lists item items inner outer top bottom left right primary secondary global"
    " group panel pane row col grid link links title text widget form field message messages thread header heading reader user users story stories slot unit strip module component region zone holder the my js is open fixed sticky hidden mobile desktop small large".split()
)
#: Of these names no element that holds an article is a wrapper, and an article with one is none.
COMMENTS = frozenset("comment comments commentlist disqus respond responses replies discussion".split())
#: A class or id of these words only names what may be the article.
CONTENT = frozenset("article entry post story content main body text blog news".split())
WORD = re.compile(r"[^\W\d_]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Runs of blocks that score below this are bridged but left out; so one menu in an article costs no more than that.
CLIP = -25.0
#: What is left out by its name costs the region around it no more than this, inside an article and elsewhere, but for menus.
OUT_IN_MAIN, OUT = -1.0, -4.0


#: Whether an element is left out: not, by a class or id that a wrapper of the article could have too, or for certain.
NOT, BY_CLASS, CERTAIN = 0, 1, 2


@lru_cache(4096)
def _by_name(token: str) -> int:
    """Whether a class or id names what is no article text: comments, cookie-notice, but not related-work or has-sidebar."""
    words = [w.lower() for w in WORD.findall(CAMEL.sub(" ", token))]
    if not any(w in NAMES for w in words) or not all(w in NAMES or w in SHAPE for w in words):
        return NOT
    return CERTAIN if any(w in COMMENTS for w in words) else BY_CLASS


@lru_cache(4096)
def _hinted(tag: str, attrs: str) -> tuple[int, bool]:
    """Whether an element is a menu, sidebar, notice, advert, form or reader comments by its name, role, class or id; whether it's a header by these."""
    if tag in DROPPED:
        return CERTAIN, False
    out, header = NOT, tag == "header"
    if tag in ("main", "html", "body") or not attrs or attrs.isspace():
        return NOT, header
    for name, *values in ATTR.findall(attrs):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return CERTAIN, header
        if name == "role" and value.lower() in ROLES:
            return CERTAIN, header
        if name in ("class", "id"):
            out = max([out, *map(_by_name, value.split())])
            words = {w.lower() for one in value.split() for w in WORD.findall(CAMEL.sub(" ", one))}
            header |= "header" in words and words <= SHAPE - {"post", "posts", "entry", "article", "articles", "story", "section", "content"}
    return out if tag != "article" or out == CERTAIN else NOT, header


@lru_cache(4096)
def _names_content(attrs: str) -> bool:
    """Whether a class or id names what may be the article."""
    for name, *values in ATTR.findall(attrs):
        if name.lower() in ("class", "id"):
            for one in "".join(values).split():
                words = [w.lower() for w in WORD.findall(CAMEL.sub(" ", one))]
                if words and CONTENT.issuperset(words):
                    return True
    return False


@dataclass
class Block:
    """Text between two borders of blocks: (text, in a link, left out) in page order, and the tags before it."""

    main: bool
    named: bool
    kind: str
    pieces: list[tuple[str, bool, int]] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)

    def text(self) -> str:
        return " ".join("".join(t for t, _, out in self.pieces if not out).split())


class Page:
    """The blocks of a page in order, by one pass over its tags; linear in the length of the page, however deep it nests."""

    def __init__(self, html: str):
        self.blocks: list[Block] = []
        mains = {NOT: False, BY_CLASS: False, CERTAIN: False}
        self.mains = mains
        #: name, in an article, in what a name says is content, kind of block, in a link, left out
        self.stack: list[tuple] = [("", False, False, "other", False, NOT)]
        self.where: dict[str, list[int]] = {}
        self.fresh(False)
        at = 0
        for m in TOKEN.finditer(html):
            if m.start() > at:
                self.add(unescape(html[at : m.start()]))
            at = m.end()
            if m["cdata"] is not None:
                self.add(m["cdata"])
            elif m["tag"]:
                (self.end if m["close"] else self.begin)(m["tag"].lower(), m["attrs"])
            elif m["raw"]:
                self.blocks[-1].tags.append(m["raw"].lower())
        self.add(unescape(html[at:]))
        self.has_main = mains[NOT] or mains[BY_CLASS]
        if mains[BY_CLASS] and not mains[NOT]:  # the class was that of a wrapper
            for b in self.blocks:
                if b.main:
                    b.pieces = [(t, link, NOT if out == BY_CLASS else out) for t, link, out in b.pieces]

    def fresh(self, cut: bool = True) -> None:
        _, main, named, kind, _, _ = self.stack[-1]
        if cut and not self.blocks[-1].pieces:
            self.blocks[-1].main, self.blocks[-1].named, self.blocks[-1].kind = main, named, kind
        else:
            self.blocks.append(Block(main, named, kind))

    def add(self, text: str) -> None:
        if text:
            *_, link, out = self.stack[-1]
            self.blocks[-1].pieces.append((text, link, out))

    def last(self, name: str) -> int:
        """Depth of the innermost open element of that name, 0 if there is none."""
        return at[-1] if (at := self.where.get(name)) else 0

    def close(self, names: set | frozenset, scope: set | frozenset = frozenset()) -> bool:
        """Closes the innermost open element of these names, and all in it, unless one of the scope stands between."""
        at = max(map(self.last, names))
        if not at or any(self.last(s) > at for s in scope):
            return False
        for name, *_ in self.stack[at:]:
            self.where[name].pop()
        del self.stack[at:]
        return True

    def begin(self, tag: str, attrs: str) -> None:
        if tag in P_CLOSERS:
            self.close({"p"}, P_SCOPE)
        if tag in AGAIN:
            while self.close(AGAIN[tag], SCOPE[tag]):
                pass
        if tag == "body":
            self.close({"head"})
        if tag not in VOID:
            _, main, named, kind, link, out = self.stack[-1]
            main = main or tag in MAIN
            named = named or tag not in ("html", "body") and _names_content(attrs)
            hinted, header = _hinted(tag, attrs)
            out = max(out, hinted, CERTAIN if header and not main else NOT)
            self.mains[out] |= tag in MAIN
            kind = "heading" if tag in HEADINGS else tag if tag in ("p", "li") else kind if tag in INLINE else "other"
            self.where.setdefault(tag, []).append(len(self.stack))
            self.stack.append((tag, main, named, kind, link or tag == "a", out))
        self.after(tag)

    def end(self, tag: str, attrs: str) -> None:
        # an end tag doesn't reach out of the element that holds it
        if tag in INLINE:
            self.close({tag}, INLINE_SCOPE)
        elif tag != "p" or not self.close({"p"}, P_SCOPE - {"li", "button", "blockquote"}):
            self.close({tag})
        self.after(tag)

    def after(self, tag: str) -> None:
        if tag == "br":
            self.add("\n")
        elif tag not in INLINE:
            self.fresh()
        self.blocks[-1].tags.append(tag)


def count_words(text: str) -> float:
    """Words of a text; where words aren't divided by spaces two characters count as one."""
    return len(text.split()) + sum("぀" <= c <= "鿿" or "가" <= c <= "힣" for c in text) / 2


def features(block: Block, has_main: bool) -> Iterator[tuple[tuple[str, ...], float]]:
    """The features of the words of a block and how many there are, in links and out of them, left out or not."""
    counts = [(count_words(t), link, out) for t, link, out in block.pieces]
    total = sum(n for n, _, _ in counts)
    size = "one" if total < 4 else "few" if total < 10 else "many"
    zone = "main" if block.main else "beside main" if has_main else "named" if block.named else "no main"
    for n, link, out in counts:
        if n:
            how = f"{zone}: link" if link else f"{zone}: plain"
            yield (zone, how, f"{how}: {block.kind}", f"{how}: {size}", "other" if out else "text"), n


def scores(page: Page, weights: dict[str, float]) -> list[float]:
    """The score of each block: words by the sum of their features' weights, tags below zero."""
    out = []
    for b in page.blocks:
        words = sum(n * max(-4.0, min(4.0, sum(weights.get(f, 0.0) for f in fs))) for fs, n in features(b, page.has_main))
        out.append(words + sum(weights.get(f"<{t}>", -0.05) for t in b.tags))
    return out


def best_run(score: list[float]) -> tuple[int, int]:
    """First and end index of the contiguous run with the greatest sum, by one linear scan; of equals the first to end,
    and of these the shortest. (0, 0) if no sum is above zero."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for k, x in enumerate(score):
        if total <= 0:
            total, start = 0.0, k
        total += x
        if total > best:
            best, span = total, (start, k + 1)
    return span


def region(page: Page, weights: dict[str, float]) -> list[Block]:
    """The blocks of the region with the highest score.

    Blocks that are left out by a name cost a little. Neighbours below zero are one item of the scan, which costs no more than CLIP: what costs more, or is three or more
    blocks of links alone outside of an article, is a menu or notice that an article can go on after, and is left out.
    """
    items: list[tuple[float, list[Block]]] = []
    named = lambda b: any(out for _, _, out in b.pieces) and not b.text()
    kind = lambda x: "out" if named(x[1]) else "low" if x[0] < 0 else "high"
    for of, group in groupby(zip(scores(page, weights), page.blocks), key=kind):
        run = list(group)
        if of == "high":
            items += [(x, [b]) for x, b in run]
            continue
        total = sum(x for x, _ in run)
        if of == "out":
            menu = sum(link and not t.isspace() for _, b in run for t, link, _ in b.pieces) >= 3
            items.append((max(total, OUT_IN_MAIN if run[0][1].main else CLIP if menu else OUT), []))
            continue
        links = [all(link for t, link, _ in b.pieces if not t.isspace()) for _, b in run if b.text()]
        menu = len(links) >= 3 and all(links) and not run[0][1].main
        items.append((max(total, CLIP), [] if total < CLIP or menu else [b for _, b in run]))
    lo, hi = best_run([x for x, _ in items])
    return [b for _, blocks in items[lo:hi] for b in blocks]


def main_text(html: str | None) -> str:
    """The main text of a page: its blocks in page order, one per line."""
    page = Page(html or "")
    blocks = region(page, weights())
    if page.has_main:
        blocks = [b for b in blocks if b.main]
    return "\n".join(t for b in blocks if (t := b.text()))


# --- weights


#: Texts of the labelled pages: title, three paragraphs, a list, words of menus, of a notice, of a comment and of a footer.
LANGUAGES = (
    ("A day out on the river", "We left early in the morning and walked along the river until noon, past the mill and the old bridge.", "Lunch was bread and cheese under a tree, and nobody wanted to go on.", "It rained.", ("Take a map", "Wear good shoes"), ("Home", "News", "About us", "Contact"), "We use cookies on this site. Accept all?", "Great story, thank you, I went there last year with my sister and we loved it.", "All rights reserved"),
    ("Wie man Brot backt", "Das Mehl wird mit Wasser, Salz und Hefe in einer großen Schüssel gemischt und zehn Minuten lang geknetet.", "Danach ruht der Teig eine Stunde an einem warmen Ort, bis er doppelt so groß ist.", "Dann backen.", ("Ein Kilo Mehl", "Zwei Löffel Salz"), ("Startseite", "Rezepte", "Über uns", "Kontakt"), "Diese Seite verwendet Cookies. Einverstanden?", "Vielen Dank für das Rezept, bei mir ist der Teig leider nicht aufgegangen.", "Alle Rechte vorbehalten"),
    ("Le conseil vote pour le pont", "Le conseil a voté mardi la réparation du vieux pont, après deux ans de débats sur le prix des travaux.", "Les habitants attendent depuis longtemps que la rue soit de nouveau ouverte aux voitures.", "Enfin.", ("Début des travaux au printemps", "Fin en automne"), ("Accueil", "Actualités", "À propos", "Nous écrire"), "Ce site utilise des cookies. Accepter ?", "Je passe par ce pont tous les jours et je suis bien content de cette décision.", "Tous droits réservés"),
    ("Los búhos cazan de noche", "Los búhos oyen a un ratón bajo la nieve y sus alas no hacen ningún ruido cuando vuelan sobre el campo.", "La mayoría anida en árboles huecos y cría dos o tres polluelos cada año.", "Duermen de día.", ("Comen ratones", "Viven en el bosque"), ("Inicio", "Noticias", "Quiénes somos", "Contacto"), "Usamos cookies en esta página. ¿Aceptar?", "Muy interesante, ayer vi uno en mi jardín y no hizo ningún ruido al volar.", "Todos los derechos reservados"),
    ("Szkło i piasek", "Szkło robi się z piasku, sody i wapna, które topi się w piecu i kształtuje, dopóki są miękkie.", "Szyby okienne pływają na roztopionej cynie, dlatego obie ich strony są całkiem płaskie.", "To wszystko.", ("Piasek jest tani", "Piec jest drogi"), ("Strona główna", "Aktualności", "O nas", "Kontakt"), "Używamy plików cookie. Zgoda?", "Bardzo ciekawy artykuł, nie wiedziałem, że szyby powstają w taki sposób.", "Wszelkie prawa zastrzeżone"),
    ("Зима в городе", "Снег шёл всю ночь, и утром дети пошли в школу пешком, потому что автобусы стояли на окраине.", "К полудню улицы расчистили, но во дворах ещё долго лежали высокие сугробы.", "Было тихо.", ("Тёплые сапоги", "Горячий чай"), ("Главная", "Новости", "О нас", "Контакты"), "Мы используем файлы cookie. Принять?", "Спасибо за рассказ, у нас в тот день тоже выпало очень много снега.", "Все права защищены"),
)
#: Layouts of the labelled pages; what stands in ⟦ ⟧ is content. {menu}, {list} and {side} are built of the texts.
LAYOUTS = (
    "<body><nav><ul>{menu}</ul></nav><div>{0}</div>⟦<article><h1>{0}</h1><p>{1}</p><p>{2} <a href=/m>{0}</a></p><p>{3}</p></article>⟧<footer>{8} {menu}</footer></body>",
    "<body><header><h2>{5[1]}</h2><a href=/>{5[0]}</a></header>⟦<main><h1>{0}</h1><p>{1}</p><ul>{list}</ul><blockquote>{2}</blockquote><h2>{4[0]}</h2><p>{3}</p></main>⟧<aside><h3>{5[1]}</h3><ol>{menu}</ol></aside><div>{8}</div></body>",
    "<body><div class=menu>{menu}</div><div class=cookie-notice><p>{6}</p></div>⟦<div id=content><h1>{0}</h1><p>{1}</p><p>{2}</p><ul>{list}</ul><p>{3}</p></div>⟧<div class=comments><p>{7}</p></div><div><a href=/x>{5[1]}</a></div><div>{8}</div></body>",
    "<body><table><tr><td><a href=/a>{5[0]}</a><br><a href=/b>{5[1]}</a><br><a href=/c>{5[2]}</a></td><td>⟦<p>{1}</p><p>{2}</p>⟧</td></tr></table><div><a href=/top>{5[3]}</a></div><div>{8}</div></body>",
    "<body><ul>{menu}</ul>⟦<section><h1>{0}</h1><p>{1} <b>{3}</b></p><p>{2}</p></section>⟧<section class=related><h3>{5[1]}</h3><ul>{menu}</ul></section><p><a href=/p>{5[2]}</a> {8}</p></body>",
    "<body><p><a href=/1>{5[0]}</a> | <a href=/2>{5[1]}</a> | <a href=/3>{5[2]}</a></p><div><article><div class=ad>{4[0]} {4[1]}</div>⟦<h1>{0}</h1><p>{1}</p><h2>{4[1]}</h2><p>{2}</p><p>{3}</p>⟧</article><div id=comments><p>{7}</p><p>{7}</p></div></div><div class=sidebar><p>{6}</p><p>{4[0]}</p></div></body>",
    "<body><div>{8}</div><div><a href=/s>{5[3]}</a></div>⟦<h1>{0}</h1><div>{1}</div><div>{2}</div><div>{3}</div>⟧<form><p>{6}</p><label>{5[3]}</label><button>OK</button></form><div><a href=/1>{5[1]}</a></div><div><a href=/2>{5[2]}</a></div></body>",
    "<body><div id=top><a href=/>{5[0]}</a> <a href=/n>{5[1]}</a></div>⟦<div class=post>{1}<br><br>{2}<br><br>{3}</div>⟧<div class=share-box><a href=/f>{5[1]}</a></div><div>{8}</div></body>",
    "<body><div>{8}</div><ul>{menu}</ul><h2>{5[1]}</h2>⟦<h1>{0}</h1><p>{1}</p><ul>{list}</ul><p>{2}</p><p>{3}</p><p>{4[0]}</p>⟧<ul>{menu}</ul><p><a href=/1>{5[2]}</a></p></body>",
    "<body><ul>{menu}</ul>⟦<div class='entry-content post'><p>{4[1]}</p><p>{1}</p><p>{3}</p><p>{2}</p><p>{4[0]}</p></div>⟧<div class=related-posts><p>{0}</p><p>{4[0]}</p></div><p>{8}</p></body>",
    "<body><table><tr><td><a href=/1>{5[0]}</a></td><td><a href=/2>{5[1]}</a></td></tr><tr>⟦<td><font size=4>{0}</font><br>{1} {2}</td>⟧</tr><tr><td>{8}</td></tr></table><div class=comment><div>{7}</div></div></body>",
)


def labelled_pages() -> Iterator[tuple[str, str, str]]:
    """Each labelled page as what stands before its content, the content, and what stands after it."""
    for texts in LANGUAGES:
        menu = "".join(f"<li><a href=/{k}>{x}</a></li>" for k, x in enumerate(texts[5]))
        items = "".join(f"<li>{x}</li>" for x in texts[4])
        for layout in LAYOUTS:
            before, content, after = re.split("[⟦⟧]", layout.format(*texts, menu=menu, list=items))
            yield before, content, after


@cache
def weights() -> dict[str, float]:
    """Log odds of content for each feature, counted in the labelled pages; for words their features add up, and a tag's
    weight is below zero."""
    inside, outside = Counter(), Counter()
    for before, content, after in labelled_pages():
        page = Page(before + content + after)
        first, end = len(Page(before).blocks) - 1, len(Page(before + content).blocks) - 1  # content begins and ends with a block
        for k, b in enumerate(page.blocks):
            into = inside if first <= k < end else outside
            for fs, n in features(b, page.has_main):
                into.update(dict.fromkeys(fs, n))
                into["word"] += n
            for t in b.tags:
                into[f"<{t}>"] += 1
                into["tag"] += 1

    def odds(f: str, of: str) -> float:
        return math.log((inside[f] + 0.5) / (inside[of] + 1)) - math.log((outside[f] + 0.5) / (outside[of] + 1))

    zones = {"main", "beside main", "named", "no main"}
    out = {}
    for f in (inside | outside).keys() - {"word", "tag"}:
        if f[0] == "<":
            out[f] = max(-1.0, min(-0.01, odds(f, "tag")))
        elif ": " in f:  # beyond what the feature before says
            out[f] = odds(f, f.rpartition(": ")[0])
        else:
            out[f] = odds(f, "word") if f in zones else 2 * odds(f, "word")
    return out


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            b = whole.slice(at, 256)
            texts = [main_text(h.as_py()) for h in b.column("html")]
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html); other columns are ignored.

    Each page is read on its own, whole, in time linear in its length: no shuffle, memory of one page. Menus, forms,
    notices, adverts and reader comments are known by names of elements, roles, and classes or ids that name nothing
    else. Of regions with equal scores the first is taken. A null or empty html, or a page without content, has an
    empty text; null ids and urls and repeated rows are passed through; no rows give no rows.
    """
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return src.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
