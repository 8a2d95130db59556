"""Main text of web pages by template deduction: classes of tokens with equal occurrence vectors.

The vector of a token says on which of its host's different pages it occurs. Tokens with equal vectors that more than half
of these pages hold, two at least, make a class if they are two or more. It is done twice:

* Tags, told apart by their path and by how often the page holds them. Those in classes are the skeleton of the
  template. On a page with that number of them, the first, second, … one are different places, and what stands between
  two places is a slot.
* Words and the order of the places, told apart by the place before them; the first, second, … occurrence of a word there
  are different tokens. So a word of a notice is another token than the same word in the story, and a place counts as
  such only where it follows the same place on most pages. Classes of these tokens complete the template.

A block of text all of whose words belong to the template is boilerplate; other blocks are what the slots hold. Vectors
are sums of hashes and never laid out, so they are combined like counts. Pages alike in tags and words, such as copies
under several urls, count as one page, and pages without tokens as none: one that is empty, cut or an error takes
nothing from the template of the others.

Of the slots, those in article and main are the text; all in them stays, but for paragraphs of the template that open
with a name such as "share", and elements inside that are called so. On pages without article and main all blocks outside
of nav, header and the like are, except those that are at least half links and stand in a place where the template has
such blocks, unless they are headings or in the slot that holds the article: the innermost element of the skeleton with
more than half of the page's own words. Names of classes decide about elements around no article, and not where more than
three quarters of the page would go.
"""

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardwatch.sources.session import materialize

#: Keys of tags and words that a worker remembers.
REMEMBERED = 200_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<svg(?=[\s/])(?:[^>\"']|\"[^\"]*\"|'[^']*')*/>"
    r"|<(script|style|noscript|template|textarea|svg|iframe|title)(?=[\s/>])[^>]*>.*?(?:</\1(?=[\s/>])[^>]*>|$)"
    r"|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|[^<]+|<",
    re.S | re.I,
)
_NAMES = re.compile(r"(?:\b(?:class|id|role)\s*=\s*)(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr input".split()
)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_NOT_NESTED = {"p", "dt", "dd", "option"}
#: Elements outside the article, and those that are only where no article is inside.
_OUTSIDE = set("nav header footer aside head button select menu dialog".split())
_SOFT = {"form"}
_OUTSIDE_NAMES = re.compile(
    r"(?:ads?|advert\w*|adbox|banner|sponsor\w*|promo\w*|menu|nav\w*|topbar|sidebar|footer|masthead|"
    r"breadcrumbs?|cookies?|consent|notices?|alerts?|pop-?up|modal|newsletter|subscri\w*|share|sharing|social|related|"
    r"comments?|replies|reply|disqus|respond|login|search)",
    re.I,
)
#: Names that begin so tell about another element: has-sidebar, no-sidebar.
_ABOUT = {"has", "no", "with", "without", "not"}
_BOXES = set("div section aside ul ol form".split())
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements of a text: they may stand in the slot of the article but are not the slot.
_TEXT = _HEADINGS | set("p ul ol li dl dt dd blockquote pre figure figcaption table thead tbody tfoot tr td th address".split())


def _called_outside(names: str, article: bool) -> bool:
    """Whether a class, id or role names what stands outside an article; in an article only a name as a whole does."""
    for name in names.split():
        if _OUTSIDE_NAMES.fullmatch(name):
            return True
        parts = re.split(r"[-_]+", name)
        if not article and parts[0].lower() not in _ABOUT:
            if any(_OUTSIDE_NAMES.fullmatch(p) or p.lower() == "header" for p in (parts[0], parts[-1])):
                return True
    return False


def read_page(source: str | None):
    """Tokens in page order: (role, words, break, outside, article, link, open elements), words for text, None for a tag.

    ``break`` tells that a block ends here; ``outside`` is 2 in elements outside any article, 1 in those that are called
    so, which an article or main inside them is not, else 0. Elements left open are closed by the end of
    what holds them. The list of open elements changes as the page goes on; each is (name, outside, article, link, path,
    role, number).
    """
    stack: list[tuple[str, int, bool, bool, str, str, int]] = []
    top, number = ("", 0, False, False, "", "", 0), 0
    for m in _TOKEN.finditer(source or ""):
        whole = m[0]
        if m[3] is None:
            if whole[:1] == "<" and len(whole) > 1:  # comments, declarations, scripts: a tag without text
                yield f"{top[4]}/{(m[1] or '!').lower()}", None, False, 2, False, False, stack
                continue
            space = (whole[:1].isspace(), whole[-1:].isspace())
            yield top[4], (html.unescape(whole).split(), space), False, top[1], top[2], top[3], stack
            continue
        if not whole.endswith(">"):
            continue  # a tag that the end of the page cuts
        name, closing = m[3].lower(), bool(m[2])
        breaks = name not in _INLINE and name != "br"
        if closing:
            role = f"{top[4]}/-{name}"
            if stack and stack[-1][0] == name:  # the usual case
                stack.pop()
                top = stack[-1] if stack else ("", 0, False, False, "", "", 0)
                yield role, None, breaks, 0, False, False, stack
                continue
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None and name in _INLINE and any(x[0] not in _INLINE for x in stack[depth + 1 :]):
                depth = None  # an inline end tag does not close blocks
            if depth is not None:
                del stack[depth:]
                top = stack[-1] if stack else ("", 0, False, False, "", "", 0)
        else:
            if breaks:
                while stack and (stack[-1][0] in _INLINE or stack[-1][0] in _NOT_NESTED and stack[-1][0] == name):
                    stack.pop()
                top = stack[-1] if stack else ("", 0, False, False, "", "", 0)
            _, outside, article, link, path, *_ = top
            role = f"{path}/{name}"
            if name in ("article", "main"):
                outside = 2 * (outside == 2)
            elif name in _OUTSIDE and not (name == "header" and article):
                outside = 2
            elif name in _SOFT:
                outside = outside or 1
            elif m[4] and not outside and name not in ("body", "html") and (not article or name in _BOXES):
                names = " ".join(x.strip("\"'") for x in _NAMES.findall(m[4]))
                outside = int(bool(names) and _called_outside(names, article))
            if name not in _VOID and not (m[4] or "").endswith("/"):
                if name not in _INLINE and name not in _NOT_NESTED:
                    path = f"{path}/{name}" if path else name
                number += 1
                top = (name, outside, article or name in ("article", "main"), link or name == "a", path, role, number)
                stack.append(top)
        yield role, None, breaks, 0, False, name == "br", stack


class _Keys(dict):
    """Hashes of strings, remembered up to a bound."""

    def __missing__(self, text: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[text] = key = xxhash.xxh64_intdigest(text) - (1 << 63)
        return key


_KEYS = _Keys()


@dataclass(slots=True)
class Block:
    """A run of text that no block tag cuts, and where it stands."""

    path: str
    article: bool
    outside: int
    after: int
    within: tuple = ()
    linked: int = 0
    words: list = field(default_factory=list)
    pieces: list = field(default_factory=list)

    def heading(self) -> bool:
        return any(x[0] in _HEADINGS for x in self.within)

    def named(self) -> bool:
        """Opens with a name such as those of elements outside the article."""
        return bool(_OUTSIDE_NAMES.fullmatch(self.words[0].strip(".,:;!?"))) and not self.heading()

    def of_links(self) -> bool:
        return 2 * self.linked >= len(self.words) and not (self.article or self.outside or self.heading())

    def text(self) -> str:
        """The words with one space between them; only where two pieces meet can there be more."""
        text = "".join(self.pieces)
        while "  " in text:
            text = text.replace("  ", " ")
        return text.strip(" ")


@dataclass(slots=True)
class Page:
    """Blocks with words, the block tags in page order with their numbers, and 128 bits of all tags and words (None for a
    page without any). Block ``b`` stands after the first ``b.after`` tags."""

    blocks: list[Block]
    order: list[str]
    tags: Counter
    content: bytes | None

    def tag_token(self, role: str) -> int:
        """A tag with the number of times that the page holds it."""
        return _KEYS[f"tag\x00{role}\x00{self.tags[role]}"]

    def places(self, skeleton) -> list[tuple[int, int]]:
        """(place, the one before) after every number of tags; places are the tags of the skeleton one by one."""
        now, found, seen = (0, 0), [(0, 0)], Counter()
        known = {role for role in self.tags if self.tag_token(role) in skeleton}
        for role in self.order:
            if role in known:
                seen[role] += 1
                now = (_KEYS[f"{role}\x00{seen[role]}"], now[0])
            found.append(now)
        return found


def parse(source: str | None, texts: bool = False) -> Page:
    """A page with its content hash, or with the texts of its blocks instead."""
    blocks, order, tags, seen, now = [], [], Counter(), [], None
    for role, text, breaks, outside, article, link, stack in read_page(source):
        if text is None:
            seen.append(role)
            if breaks:
                order.append(role)
                now = None
            elif texts and link and now:
                now.pieces.append(" ")
            continue
        found, (before, after) = text
        if now and (now.article != article or now.outside != outside):
            now = None
        if not found:
            if texts and now and (before or after):
                now.pieces.append(" ")
            continue
        if now is None:
            within = () if outside == 2 else tuple(stack)
            now = Block(role, article, outside, len(order), within)
            blocks.append(now)
        if link:
            now.linked += len(found)
        now.words += found
        joined = " ".join(found)
        if texts:
            now.pieces.append(f"{' ' if before else ''}{joined}{' ' if after else ''}")
        else:
            seen.append(f"{role}\x00{joined}")
    tags.update(order)
    some = bool(blocks or tags) and not texts
    return Page(blocks, order, tags, xxhash.xxh3_128_digest("\x00".join(seen)) if some else None)


def tag_tokens(page: Page) -> set[int]:
    return {page.tag_token(role) for role in page.tags}


def _word_keys(block: Block, place: int, seen: Counter) -> list[int]:
    """The tokens of a block's words; ``seen`` counts the words of the page so far."""
    out = []
    for w in block.words:
        word = f"{place}\x00{block.path}\x00{w}"
        seen[word] += 1
        out.append(_KEYS[f"{word}\x00{seen[word]}"])
    return out


def _order_key(place: tuple[int, int]) -> int:
    return _KEYS[f"order\x00{place[0]}\x00{place[1]}"]


def _links_key(block: Block, place: int) -> int:
    return _KEYS[f"links\x00{place}\x00{block.path}"]


def _judged(block: Block) -> bool:
    """Whether the template decides about a block; others stay or go anyway."""
    return block.outside != 2 and (not block.article or block.named())


def word_tokens(page: Page, skeleton) -> set[int]:
    """Words by their place, but for those that stay whatever the template; the order of places; places of link blocks."""
    places, seen = page.places(skeleton), Counter()
    out = {_order_key(p) for p in places}
    for b in page.blocks:
        if _judged(b):
            out.update(_word_keys(b, places[b.after][0], seen))
            if b.of_links():
                out.add(_links_key(b, places[b.after][0]))
    return out


def classes(pages: DataFrame, tokens) -> DataFrame:
    """``host`` and ``token`` of the tokens that share their occurrence vector with another one and that more than half
    of the host's different pages hold.

    ``tokens(page, skeleton)`` gives those of a page. Different pages are found by a shuffle on host and content; a vector
    is the exclusive or of a hash per page, combined within tasks before the shuffle, so that a host with a third of all
    pages is not gathered anywhere.
    """

    def collect(batches):
        for batch in batches:
            rows, known = {}, {}
            for i, (host, source) in enumerate(zip(batch.column("host").to_pylist(), batch.column("page").to_pylist())):
                page = parse(source)
                if page.content is not None and (host, page.content) not in rows:
                    rows[host, page.content] = [0, *tokens(page, _known(batch, "skeleton", i, host, known))]
            hosts, contents = zip(*rows) if rows else ((), ())
            columns = [pa.array(hosts, pa.string()), pa.array(contents, pa.binary()), pa.array(rows.values(), pa.list_(pa.int64()))]
            yield pa.record_batch(columns, ["host", "content", "tokens"])

    found = pages.mapInArrow(collect, "host string, content binary, tokens array<bigint>")
    found = found.groupBy("host", "content").agg(F.first("tokens").alias("tokens"))
    each = found.select("host", F.xxhash64("content").alias("page"), F.explode("tokens").alias("token"))
    counts = each.groupBy("host", "token").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("page").alias("vector"))
    counts = materialize(counts.where("token = 0 OR n > 1"))
    total = counts.where("token = 0").select("host", F.col("n").alias("pages"))
    shared = materialize(counts.where("token <> 0").join(total, "host").where("2 * n > pages"))
    size = shared.groupBy("host", "vector", "n").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return shared.join(size, ["host", "vector", "n"]).select("host", "token")


def _known(batch, name: str, i: int, host: str, known: dict) -> frozenset:
    """The tokens of a host in a column of the batch, taken once per batch."""
    if name not in batch.schema.names:
        return frozenset()
    if host not in known:
        known[host] = frozenset(batch.column(name)[i].as_py() or ())
    return known[host]


def with_host(pages: DataFrame, url_col: str, html_col: str, *kept) -> DataFrame:
    url = F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select(*kept, host.alias("host"), F.col(f"`{html_col}`").alias("page"))


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host``, ``skeleton`` and ``words``: the tokens of tags in the template, and those of words, order and link blocks.

    A host with one different page has neither. The tokens of a host number at most twice those of an average page.
    """
    source = with_host(pages, url_col, html_col)
    tags = classes(source, lambda page, _: tag_tokens(page))
    skeletons = materialize(tags.groupBy("host").agg(F.collect_list("token").alias("skeleton")))
    words = classes(source.join(skeletons, "host", "left"), word_tokens)
    return materialize(skeletons.join(words.groupBy("host").agg(F.collect_list("token").alias("words")), "host", "full"))


def _slot(page: Page, kept: list[Block], skeleton) -> int | None:
    """The number of the innermost element of the skeleton, opened and closed alike, with more than half of the words
    outside links."""
    weight, elements = Counter(), {}
    for b in kept:
        for x in b.within:
            weight[x[6]] += len(b.words) - b.linked
            elements[x[6]] = x
    total = sum(len(b.words) - b.linked for b in kept)
    for number in sorted(elements, reverse=True):
        name, _, _, _, path, role, _ = elements[number]
        if 2 * weight[number] > total and name not in _INLINE and name not in _TEXT:
            ends = f"{path}/-{name}"
            if page.tags[role] == page.tags[ends] and all(page.tag_token(r) in skeleton for r in (role, ends)):
                return number
    return None


def main_text(source: str | None, skeleton, words) -> str:
    """The text of one page under its host's template."""
    page = parse(source, texts=True)
    places, seen = page.places(skeleton), Counter()
    frame = set()
    for b in page.blocks:
        if _judged(b):
            place = places[b.after]
            own = _word_keys(b, place[0], seen)
            if _order_key(place) in words and all(k in words for k in own):
                frame.add(id(b))

    def boilerplate(b: Block) -> bool:
        return id(b) in frame

    here = [b for b in page.blocks if b.outside != 2]
    article = [b for b in here if b.article and not b.outside and not (b.named() and boilerplate(b))]
    if article or any(b.article for b in here):
        return "\n\n".join(b.text() for b in article)
    kept = [b for b in here if not boilerplate(b)]
    own = [b for b in kept if not b.outside]
    # Names decide as long as they do not take most of the page.
    if 4 * sum(len(b.words) - b.linked for b in own) >= sum(len(b.words) - b.linked for b in kept):
        kept = own
    if any(b.of_links() for b in kept):
        slot = _slot(page, kept, skeleton)
        inside = [slot is None or any(x[6] == slot for x in b.within) for b in kept]
        kept = [b for b, i in zip(kept, inside) if i or not (b.of_links() and _links_key(b, places[b.after][0]) in words)]
    return "\n\n".join(b.text() for b in kept)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every row.

    Character references are decoded, white space inside a block becomes one space, blocks are joined by an empty line.
    A null or empty page, or one without an article or other text of its own, has an empty text. Null urls form one
    host of their own; a host with one page has no template. Null and repeated ids keep their rows. Pages of any length
    are read whole. Other columns are not read. An empty table gives an empty table.

    The templates are a stored table, one short row per host; pages are joined with it, by broadcast where its size
    is below the session's limit, else by a shuffle that may split large hosts.
    """
    deduced = templates(pages, url_col, html_col)
    source = with_host(pages, url_col, html_col, F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"))
    joined = source.join(deduced, "host", "left")

    def extract(batches):
        for batch in batches:
            skeletons, words, texts = {}, {}, []
            for i, (page, host) in enumerate(zip(batch.column("page").to_pylist(), batch.column("host").to_pylist())):
                known = _known(batch, "skeleton", i, host, skeletons), _known(batch, "words", i, host, words)
                texts.append(main_text(page, *known))
            yield pa.record_batch(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kind = dict(source.dtypes)["page_id"]
    return joined.mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars long")
