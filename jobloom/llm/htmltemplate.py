"""Main-text extraction by equivalence classes of template tokens.

Tokens are elements (a hash of tag, class and id of it and of every element around it) and texts with the element they
stand in. For each host, a token's occurrence vector over all of the host's pages is kept as page count, occurrence
count and order-free sums of hashes of (page, count); tokens with equal vectors form an equivalence class. A class
is valid if it covers at least half of the host's pages, and two at least. Its tokens that do not come in the same order and
inside the same elements wherever they occur are taken out (a class that repeats may repeat as a whole).

Valid classes nest into the host's template: elements that occur once a page are its nodes, texts on WORD_SUPPORT of its
pages, and on MIN_WORD_PAGES at least, its words. What lies between nodes are slots. Where the template has nodes that are `main` or
`article`, the slots inside them are extracted whole: a sentence that every article of a host holds is still its text. Of
what lies around them, the slots that lie directly in a node around them are extracted, and those of titles (h1) there, both
without words; the slots of other nodes beside them are not (menus, adverts, notices, related links, whatever they are called).
Where the template has no main nodes, or a page lacks them, every slot is extracted without words, as nothing but names and
repetition tells slots apart. Words are left out only where a tenth (LEAST_OWN) of the text at least remains: pages with less of their own are editions
of one text, and keep them.

Elements whose tag or role says that they are no main text (nav, header, footer, aside, form, script, style and
others), and elements with a class or id made of names for such things only, are left out too, unless they hold the main text; a class or
id never outweighs the template. Character references are decoded, white space inside a block becomes one space, blocks
are trimmed and joined by line feeds.

Defined results: null or empty html gives an empty text; text outside all elements is kept; a null or relative url
belongs to the host ''; repeated pages give repeated rows; a host with one page has no template; an empty table gives
an empty result; other columns are ignored. Vectors are aggregated on the map side, so a hot host is not gathered
anywhere. Work and memory for a page are in proportion to its length, however deep its elements are nested. The table of
templates is broadcast only if it holds at most MAX_BROADCAST_TOKENS tokens, else joined.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written

MIN_SUPPORT, MIN_PAGES = 0.5, 2
WORD_SUPPORT, MIN_WORD_PAGES, LEAST_OWN = 0.9, 5, 0.1
MAX_BROADCAST_TOKENS = 1_000_000  # 16 bytes each

_TAG = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>", re.S)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option".split())
_BOILERPLATE = frozenset("nav header footer aside form script style noscript template iframe svg button select textarea head title dialog menu object canvas xmp noembed noframes".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead"), "body": ("head",)}
_SCOPES = frozenset("ul ol dl table article section div body main td th".split())
#: Elements at which a look up the stack for implied end tags can stop.
_STOPS = _SCOPES | {"p"} | {name for ends in _CLOSES.values() for name in ends}
#: Parts of class and id names: a name is telling if all its parts are among these and one is among the first.
_TELLING = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert sidebar menu nav navbar navigation footer header masthead comment comments respond replies disqus share sharing social newsletter subscribe popup modal related breadcrumb breadcrumbs pagination widget widgets".split())
_NEUTRAL = frozenset("area bar block bottom box btn buttons container content count form group holder inner item items left links list outer page panel row right section site slot top unit wrap wrapper posts reader user".split())
_COMMENTS = frozenset("comment comments respond replies disqus".split())
#: Elements that never hold a page's main text.
_ALWAYS = _BOILERPLATE - {"header", "form", "dialog", "object", "canvas"}
NONE, BY_TAG, BY_NAME, BY_COMMENT = range(4)
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
_MAIN = ("main", "article")


def _id(*parts) -> int:
    """A 62-bit hash, never 0."""
    return (xxhash.xxh64_intdigest("\0".join(map(str, parts))) >> 2) | 1


def _mark_of(value: str) -> int:
    """What a class or id says: of its names, one that is made of boilerplate words."""
    mark = NONE
    for name in value.split():
        parts = [x for x in re.split(r"[-_]+|(?<=[a-z])(?=[A-Z])", name) if x]
        low = [x.lower() for x in parts]
        low = ["sidebar"] if low == ["side", "bar"] else low
        if low and any(x in _TELLING for x in low) and all(x in _TELLING or x in _NEUTRAL or x.isdigit() for x in low):
            mark = BY_COMMENT if mark == BY_COMMENT or any(x in _COMMENTS for x in low) else BY_NAME
    return mark


def walk(page: str):
    """Yield ('open', path, tag, own mark), ('text', text), ('void', path, tag) and ('close', path, tag) in page order."""
    stack: list[tuple[str, int]] = []
    stops: list[int] = []  # where in the stack elements of _STOPS are
    held: Counter[str] = Counter()
    at, size = 0, len(page)

    def pop():
        name, path = stack.pop()
        held[name] -= 1
        if stops and stops[-1] == len(stack):
            stops.pop()
        return ("close", path, name, NONE)

    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            yield ("text", page[at:], None, NONE)
            break
        if m.start() > at:
            yield ("text", page[at : m.start()], None, NONE)
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if held[name]:
                while stack[-1][0] != name:
                    yield pop()
                yield pop()
            continue
        if name in _BLOCK and stops and stack[stops[-1]][0] == "p":  # a new block ends an open paragraph
            depth = stops[-1]
            while len(stack) > depth:
                yield pop()
        ends = _CLOSES.get(name, ())
        for k in reversed(stops) if ends else ():
            if stack[k][0] in ends:
                while len(stack) > k:
                    yield pop()
                break
            if stack[k][0] in _SCOPES:
                break
        label, mark = name, BY_TAG if name in _BOILERPLATE else NONE
        if m[3]:
            for key, a, b, c in _NAMED.findall(m[3]):
                value = a or b or c
                if key.lower() == "role":
                    mark = BY_TAG if value.strip().lower() in _ROLES else mark
                elif name not in ("html", "body"):
                    label += ("." if key.lower() == "class" else "#") + " ".join(value.split())
                    if mark != BY_TAG and name not in _MAIN:
                        mark = max(mark, _mark_of(value))
        path = _id(stack[-1][1] if stack else 0, label)
        if name in _VOID:
            yield ("void", path, name, NONE)
            continue
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if name in _STOPS:
            stops.append(len(stack))
        stack.append((name, path))
        held[name] += 1
        yield ("open", path, name, mark)
    while stack:
        yield pop()


def events(page: str, names: bool = True) -> list[tuple]:
    """walk() with each element's mark settled and handed down: whether it is boilerplate.

    A name says nothing of what else an element holds. An element keeps no mark if it holds `main`, the longest
    article (comments can hold articles of their own), or, on pages that have neither elsewhere, half of the text
    outside elements that are boilerplate by tag or role. Without `names`, only elements of _ALWAYS are boilerplate.
    """
    seen = list(walk(page))
    if not names:
        settled = {k: e[2] in _ALWAYS for k, e in enumerate(seen) if e[0] == "open"}
    else:
        spans, open_, text, free = {}, [], [0] * (len(seen) + 1), [0] * (len(seen) + 1)
        tagged = 0
        for k, (kind, path, _, mark) in enumerate(seen):
            n = 0
            if kind == "open":
                open_.append(k)
                tagged += mark == BY_TAG
            elif kind == "close":
                at = open_.pop()
                spans[at] = k
                tagged -= seen[at][3] == BY_TAG
            elif kind == "text":
                n = len(path.strip())
            text[k + 1], free[k + 1] = text[k] + n, free[k] + (0 if tagged else n)
        length = lambda k: text[spans[k]] - text[k]
        full = lambda name: [0, *accumulate(k in spans and e[2] == name and e[0] == "open" and length(k) > 0 for k, e in enumerate(seen))]
        mains, articles = full("main"), full("article")
        longest = max((k for k in spans if seen[k][2] == "article" and length(k)), key=lambda k: (length(k), -k), default=None)

        def keeps(k):
            mark, end = seen[k][3], spans[k]
            if mains[end] > mains[k] or (mark != BY_COMMENT and longest is not None and k <= longest < end):
                return False
            within = mains[end] - mains[k] + articles[end] - articles[k] == mains[-1] + articles[-1]
            return not (mark != BY_TAG and within and 2 * (free[end] - free[k]) >= free[-1] > 0)

        settled = {k: seen[k][3] != NONE and keeps(k) for k in spans}
    out, held = [], [False]
    for k, (kind, path, tag, _) in enumerate(seen):
        if kind == "open":
            held.append(held[-1] or settled[k])
        out.append((kind, path, tag, held[-1]))
        if kind == "close":
            held.pop()
    return out


def text_token(path: int, text: str) -> int:
    return _id(path, "text", " ".join(text.split()))


def page_tokens(page: str):
    """(token, is a text, is main or article) of a page's elements and texts outside boilerplate, in page order; None where an element ends."""
    open_: list[tuple[int, bool]] = [(0, False)]
    for kind, path, tag, marked in events(page):
        if kind == "open":
            open_.append((path, marked))
            if not marked:
                yield path, False, tag in _MAIN
        elif kind == "close":
            if not open_.pop()[1]:
                yield None
        elif kind == "text" and not open_[-1][1] and path.strip():
            yield text_token(open_[-1][0], path), True, False


def orders_of(page: str, classes: dict[int, int]) -> dict[int, int]:
    """Token -> hash of where it stands on a page: after which tokens of its class, and inside which token of any class.

    Tokens whose places are equal on all pages are in one order and one nest on all of them.
    """
    found: dict[int, list[tuple[int, int]]] = {}
    around = [0]
    for one in page_tokens(page):
        if one is None:
            around.pop()
            continue
        token, text, _ = one
        if token in classes:
            found.setdefault(classes[token], []).append((token, around[-1]))
        if not text:
            around.append(token if token in classes else around[-1])
    out = {}
    for order in found.values():
        size = order.index(order[0], 1) if order[0] in order[1:] else len(order)
        repeats = order[:size] * (len(order) // size) == order
        whole, before = "" if repeats else _id(order), 0
        for token, outer in order[:size] if repeats else order:
            if token not in out:
                out[token] = _id(before, outer, whole)
                before ^= token
    return out


def extract(page: str | None, nodes: frozenset[int] = frozenset(), words: frozenset[int] = frozenset()) -> str:
    """The text in a page's slots: those of main nodes and around them, else all, else without regard to names; template words as the module says."""
    if not page:
        return ""
    found_in = events(page)
    for names, slots in ((True, nodes), (True, frozenset()), (False, frozenset())):
        found_in = found_in if names else events(page, False)
        for left_out in (words, frozenset()) if words else (frozenset(),):
            blocks, dropped = _blocks_of(found_in, slots, left_out)
            if sum(map(len, blocks)) >= LEAST_OWN * (dropped + sum(map(len, blocks))):
                break
        if blocks:
            return "\n".join(blocks)
    return ""


def _blocks_of(found_in: list[tuple], slots: frozenset[int], left_out: frozenset[int]) -> tuple[list[str], int]:
    """(blocks of the wanted slots, characters of the template words that were left out of them)."""
    blocks: list[str] = []
    parts: list[str] = []
    dropped = 0

    def flush():
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            blocks.append(text)
        parts.clear()

    around, main = _around_main(found_in, slots)
    # of each open element: its path, whether it is skipped, whether it is in a main node, whether its slots are wanted
    open_: list[tuple[int, bool, bool, bool]] = [(0, False, False, True)]
    for k, (kind, path, tag, marked) in enumerate(found_in):
        outer, skipped, inside, wanted = open_[-1]
        if kind == "text":
            if not skipped and wanted:
                if left_out and not inside and text_token(outer, path) in left_out:
                    dropped += len(" ".join(path.split()))
                else:
                    parts.append(path)
            continue
        if tag in _BLOCK:
            flush()
        elif kind == "void" and tag == "br":
            parts.append(" ")
        if kind == "open":
            inside |= path in main
            if path in slots and main:
                wanted = inside or k in around or (tag == "h1" and wanted)
            open_.append((path, marked, inside, wanted))
        elif kind == "close":
            open_.pop()
    flush()
    return blocks, dropped


def _around_main(found_in: list[tuple], nodes: frozenset[int]) -> tuple[set[int], set[int]]:
    """(events that open nodes around a main node, paths of main nodes); of nested ones the outermost counts."""
    main = {path for kind, path, tag, marked in found_in if kind == "open" and tag in _MAIN and not marked and path in nodes}
    around: set[int] = set()
    open_: list[int] = []
    if main:
        for k, (kind, path, _, _) in enumerate(found_in):
            if kind == "open":
                if path in main:
                    around.update(open_)
                    open_ = []  # what is further out is known
                open_.append(k)
            elif kind == "close" and open_:
                open_.pop()
    return around, main


def host_of(url: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _bounded(hosts: DataFrame, tokens: DataFrame) -> DataFrame:
    """hosts, to be broadcast if the tokens in it are few enough."""
    return F.broadcast(hosts) if tokens.count() <= MAX_BROADCAST_TOKENS else hosts


def _vectors(own: DataFrame) -> DataFrame:
    """host, token, is_text, pages, n, low, high: occurrence vectors of all tokens; token 0 is the page itself."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                held: dict[tuple[str, int, bool], list[int]] = {}
                for host, page_id, page in zip(*(c.to_pylist() for c in batch.slice(lo, 200).columns)):
                    seen = Counter({(0, False): 1})
                    seen.update(one[:2] for one in page_tokens(page or "") if one)
                    for (token, text), n in seen.items():
                        code = xxhash.xxh64_intdigest(f"{page_id}:{n}")
                        one = held.setdefault((host, token, text), [0, 0, 0, 0])
                        one[0] += 1
                        one[1] += n
                        one[2] += code & 0xFFFFFFFF
                        one[3] += code >> 32
                hosts, tokens, texts = zip(*held) if held else ((), (), ())
                numbers = np.array(list(held.values()), np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(tokens, pa.int64()), pa.array(texts, pa.bool_()), *(pa.array(numbers[:, k]) for k in range(4))], names=["host", "token", "is_text", "pages", "n", "low", "high"])

    seen = own.mapInArrow(run, "host string, token long, is_text boolean, pages long, n long, low long, high long")
    return seen.groupBy("host", "token", "is_text").agg(*[F.sum(c).alias(c) for c in ("pages", "n", "low", "high")])


def templates(pages: DataFrame) -> DataFrame:
    """One row per token of a host's template: host, token, is_text, class. Valid classes in one order and nest, nodes and words."""
    own = pages.select(host_of("url").alias("host"), F.col("page_id").cast("long").alias("page_id"), "html")
    vectors = written(_vectors(own), "vectors")
    # the page itself is a token of every page, so a host's rows all come with its size
    size = vectors.where("token = 0").select("host", F.col("pages").alias("host_pages"))
    enough = (F.col("pages") >= MIN_SUPPORT * F.col("host_pages")) & (F.col("pages") >= MIN_PAGES)
    node = ~F.col("is_text") & (F.col("n") == F.col("pages"))
    word = F.col("is_text") & (F.col("pages") >= WORD_SUPPORT * F.col("host_pages")) & (F.col("pages") >= MIN_WORD_PAGES)
    found = vectors.where("token <> 0").join(size, "host").where(enough & (node | word))
    found = written(found.select("host", "token", "is_text", F.xxhash64("pages", "n", "low", "high").alias("class")), "classes")
    known = _bounded(found.groupBy("host").agg(F.collect_list(F.struct("token", "class")).alias("known")), found)
    laid = own.join(known, "host").select("host", "html", "known")

    def order(batches):
        for batch in batches:
            held: dict[tuple[str, int], list[int]] = {}
            classes: dict[str, dict[int, int]] = {}
            for lo in range(0, batch.num_rows, 200):
                rows = batch.slice(lo, 200)
                for k, (host, page) in enumerate(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist())):
                    if host not in classes:
                        classes[host] = {t["token"]: t["class"] for t in rows.column(2)[k].as_py()}
                    for token, value in orders_of(page or "", classes[host]).items():
                        one = held.setdefault((host, token), [value, value])
                        one[0], one[1] = min(one[0], value), max(one[1], value)
            hosts, names = zip(*held) if held else ((), ())
            low, high = zip(*held.values()) if held else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(names, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["host", "token", "low", "high"])

    valid = laid.mapInArrow(order, "host string, token long, low long, high long").groupBy("host", "token").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low = high").select("host", "token")
    out = written(found.join(valid, ["host", "token"]), "template")
    drop_written(vectors)
    drop_written(found)
    return out


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    tokens = templates(pages)
    hosts = tokens.groupBy("host").agg(F.collect_list(F.when(~F.col("is_text"), F.col("token"))).alias("nodes"), F.collect_list(F.when(F.col("is_text"), F.col("token"))).alias("words"))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of("url").alias("host")).join(_bounded(hosts, tokens), "host", "left").select("page_id", "url", "html", "host", "nodes", "words")

    def run(batches):
        for batch in batches:
            known: dict[str, tuple[frozenset[int], frozenset[int]]] = {}
            for lo in range(0, batch.num_rows, 200):
                rows, texts = batch.slice(lo, 200), []
                for k, (page, host) in enumerate(zip(rows.column(2).to_pylist(), rows.column(3).to_pylist())):
                    if host not in known:
                        known[host] = frozenset(rows.column(4)[k].as_py() or ()), frozenset(rows.column(5)[k].as_py() or ())
                    texts.append(extract(page, *known[host]))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
