"""Main text of web pages by wrappers inferred per host.

Every page is read as a stream of tags and text. Aligning the streams of one host gives
its wrapper, an expression without unions: where streams agree the token stays, equal
neighbours fold into a repeated group, what one stream lacks becomes optional, and text
that differs becomes a slot. Texts that most different pages of the host share are
fixed (counted first, so that they align with their like only). The wrapper says how much
text its slots hold over all pages, which picks the part of the page that is the article; its
optional and repeated groups show which parts inside are lists of reader comments and the
like. Each page's text is read from the article without these and the fixed texts, or, if the page does
not have it, from the part its own one-page wrapper picks.

Wrappers are folded inside the tasks first, then in salted groups, then per host, so a
host with a third of all pages is no hot spot; nodes are named by tag and the names that
recur on the host's pages, so the wrappers' size follows the template, not the number of pages.

Defined cases: null and empty html give an empty text; a null url belongs to the host
without a name; unclosed and stray tags are repaired as browsers do; nodes nested deeper
than 64 count as part of their ancestor in the wrapper; repeated rows are extracted
alike; other columns are not looked at.
"""
from __future__ import annotations

import bisect
import hashlib
import html as entities
import json
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from palaver.session import materialize

from .urls import split_url

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^<>"']|"[^"]*"|'[^']*'|["'])*)(?:>|(?=<)|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
# Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body dd dt head html legend li summary tbody td tfoot th thead tr".split())
SIBLINGS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table menu select html body article div section".split())
# Parts that are never main text, by tag and role.
DROPPED = frozenset("head nav footer aside form script style noscript template button select textarea title iframe svg object dialog menu header".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
# Words of class and id that hint at such a part.
NAMES = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies discussion disqus footer header hidden login masthead menu "
    "modal nav navbar navigation newsletter notice notices pagination popup promo promoted related replies respond share sharing sidebar signup social sponsor "
    "sponsored subscribe toolbar topbar widget".split())
# Hints only as a whole name: in a compound (overflow-hidden, related-work, entry-header) they say too little.
WEAK = frozenset("ad ads banner comment discussion header hidden notice notices related replies respond share sharing social widget".split())
LAYOUT = frozenset("has no with without".split())  # such a name (has-sidebar) says what stands beside or in the part
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
MAX_DEPTH = 64
# What an open tag says of its part: nothing, never main text, or (a longer text) the hint it gives.
PLAIN, OFF, STRONG = "", "-", "h:"


def _label(tag: str, attributes: str, known: set[str] | None) -> tuple[str, str]:
    """Name of a node for alignment, and what it says of its part of the page."""
    said = OFF if tag in DROPPED else PLAIN
    if not attributes or attributes.isspace():
        return tag, said
    own: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attributes):
        own.setdefault(m[1].lower(), (m[2] or "").strip("\"'"))
    names, hints, strong = [], set(), False
    for kind in ("class", "id"):
        words: set[str] = set()
        for name in own.get(kind, "").split():
            found = {w.lower() for w in WORD.findall(name)}
            words |= found
            if not found & LAYOUT:
                hints |= found & NAMES
                strong |= bool(found & NAMES - WEAK) or name.lower() in NAMES
        names += sorted(words)
    role = own.get("role", "").lower()
    names += ["@main"] if role == "main" else []
    if role in ROLES or "hidden" in own or own.get("aria-hidden", "").lower() == "true" or "display:none" in own.get("style", "").replace(" ", "").lower():
        said = OFF
    elif hints and said != OFF and tag not in ("html", "body", "article", "main"):
        said = (STRONG if strong else "w:") + ".".join([tag, *sorted(hints)])
    if known is not None:  # names of few pages (generated ones) would never align
        names = [n for n in names if f"n:{n}" in known or n == "@main"]
    return ".".join([tag, *names]), said


def events(page: str, known: set[str] | None = None) -> Iterator[tuple[str, str, str]]:
    """("open", label, what it says), ("close", label, _) and ("text", text, _) with missing end tags supplied."""
    stack: list[tuple[str, str]] = []
    at, end = 0, len(page)

    def close_to(depth: int) -> Iterator[tuple[str, str, str]]:
        while len(stack) > depth:
            yield "close", stack.pop()[1], PLAIN

    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            yield "text", page[at:], PLAIN
            break
        if m.start() > at:
            yield "text", page[at:m.start()], PLAIN
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None:
                yield from close_to(depth)
            continue
        if tag in CLOSES_P:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in ("p", "button", "table")), None)
            if depth is not None and stack[depth][0] == "p":
                yield from close_to(depth)
        for i in range(len(stack) - 1, -1, -1) if tag in SIBLINGS else ():
            if stack[i][0] in SIBLINGS[tag]:
                yield from close_to(i)
                break
            if stack[i][0] in SCOPE:
                break
        if tag in VOID:
            yield "text", " ", PLAIN
            continue
        label, said = _label(tag, m[3], known)
        if tag == "header" and any(t in ("article", "main") or "@main" in x.split(".") for t, x in stack):
            said = PLAIN  # the article's own heading
        yield "open", label, said
        if tag in RAW:
            stop = re.compile(f"</{tag}", re.I).search(page, at)
            at = stop.start() if stop else end
        stack.append((tag, label))
    yield from close_to(0)


def parts(page: str, known: set[str] | None = None) -> Iterator[tuple[str, str, str]]:
    """The events of blocks; texts between them as one run each, with inline nodes dissolved and dropped ones left out."""
    text: list[str] = []
    nodes: list[tuple[bool, bool]] = []  # a block, a dropped inline node
    off = 0

    for kind, value, said in events(page, known):
        if kind == "text":
            if not off:
                text.append(entities.unescape(value))
            continue
        if kind == "open":
            block = not off and value.partition(".")[0] in BLOCK
            nodes.append((block, not block and said == OFF))
            off += nodes[-1][1]
        else:
            block, dropped = nodes.pop()
            off -= dropped
        if block:
            run = " ".join("".join(text).split())
            text.clear()
            if run:
                yield "text", run, PLAIN
            yield kind, value, said
    run = " ".join("".join(text).split())
    if run:
        yield "text", run, PLAIN


def _key(base: str, run: str) -> str:
    return "t:" + hashlib.blake2b(f"{base}\0{run}".encode("utf-8", "replace"), digest_size=8).hexdigest()


def facts(page: str) -> tuple[int, set[tuple[str, str]]]:
    """Checksum of a page's texts, and its (base, token) pairs: runs of text, counted among all pages or among those with the same hint, and names of nodes; token "" counts the base."""
    found, whole = {("p", "")}, hashlib.blake2b(digest_size=8)
    stack = [("p", False)]
    for kind, value, said in parts(page):
        base, off = stack[-1]
        if kind == "open":
            if len(said) > 1:
                base = said
                found.add((base, ""))
            stack.append((base, off or said == OFF))
            found |= {("p", f"n:{name}") for name in value.split(".")[1:]}
        elif kind == "close":
            stack.pop()
        elif not off:
            whole.update(value.encode("utf-8", "replace") + b"\0")
            found.add((base, _key(base, value)))
    return int.from_bytes(whole.digest(), "big", signed=True), found


def _facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = set()
        for host, page in zip(batch["host"], batch["html"]):
            digest, found = facts(page)
            rows |= {(host, base, token, digest) for base, token in found}
        yield pd.DataFrame(sorted(rows), columns=["host", "base", "token", "digest"])


def host_facts(pages: DataFrame) -> DataFrame:
    """host, known (array of tokens) of hosts with several different pages: texts that most of the pages, or of the parts with one hint, share, and names of nodes.

    Most is more than half and at least 10 pages, or four fifths; a name needs two pages and a
    tenth of all. So the tokens are some times those of one page at most. Pages with equal texts count once.
    """
    seen = pages.where(F.col("html").isNotNull()).select("host", "html").mapInPandas(_facts, "host string, base string, token string, digest bigint")
    counts = materialize(seen.groupBy("host", "base", "token").agg(F.countDistinct("digest").alias("n")).where("n > 1"), "facts")
    sizes = counts.where("token = ''").select("host", "base", F.col("n").alias("all"))
    common = counts.join(sizes, ["host", "base"]).where("if(token like 'n:%', 10 * n >= all, if(n >= 10, 2 * n > all, 5 * n >= 4 * all))")
    return common.groupBy("host").agg(F.collect_set("token").alias("known"))


# A wrapper node: [label, pages, repeated, optional, text, chars, dropped, children, hinted, fixed].
# text: 0 none, a checksum while it is the same everywhere, -1 a slot; chars: of slot text; fixed: of text that the host's pages share.
LABEL, PAGES, REPEATED, OPTIONAL, TEXT, CHARS, DROP, CHILDREN, HINT, FIXED = range(10)
FEW = 10  # with fewer pages a host's shared text may come from copies of one article


def page_wrapper(page: str, known: set[str] | None = None) -> list:
    """The one-page wrapper, equal neighbours folded; nodes of fixed text alone carry it in their label, so they fold and align with their like only."""
    root = ["#page", 1, False, False, 0, 0, False, [], False, 0]
    stack, bases = [root], ["p"]
    for kind, value, said in parts(page, known):
        if kind == "open":
            bases.append(said if len(said) > 1 else bases[-1])
            if len(stack) > MAX_DEPTH:
                stack.append(stack[-1])
            else:
                node = [value, 1, False, False, 0, 0, said == OFF or stack[-1][DROP], [], said.startswith(STRONG), 0]
                stack[-1][CHILDREN].append(node)
                stack.append(node)
        elif kind == "close":
            node = stack.pop()
            bases.pop()
            if node is not stack[-1]:
                node[CHILDREN] = _fold(node[CHILDREN])
                if node[FIXED] and not node[CHARS] and not node[CHILDREN]:
                    node[LABEL] += f"={node[TEXT]}"
        else:
            node = stack[-1]
            node[TEXT] = zlib.crc32(value.encode("utf-8", "replace"), node[TEXT]) | 1
            node[FIXED if known and _key(bases[-1], value) in known else CHARS] += len(value)
    root[CHILDREN] = _fold(root[CHILDREN])
    return root


def _fold(children: list[list], longest: int = 3) -> list[list]:
    """Equal neighbours, or equal neighbouring groups of up to ``longest`` nodes, become repeated nodes."""
    out: list[list] = []
    for node in children:
        out.append(node)
        for p in range(1, longest + 1):
            if len(out) >= 2 * p and all(out[-p + i][LABEL] == out[-2 * p + i][LABEL] for i in range(p)):
                for i in range(p):
                    pages = out[-2 * p + i][PAGES]
                    out[-2 * p + i] = merge(out[-2 * p + i], out[-p + i])
                    out[-2 * p + i][PAGES], out[-2 * p + i][REPEATED] = pages, True
                del out[-p:]
                break
    return out


def merge(a: list, b: list) -> list:
    """Two wrappers of one node aligned into one."""
    text = a[TEXT] if a[TEXT] == b[TEXT] else -1
    return [a[LABEL], a[PAGES] + b[PAGES], a[REPEATED] or b[REPEATED], a[OPTIONAL] or b[OPTIONAL], text, a[CHARS] + b[CHARS],
            a[DROP] and b[DROP], _align(a[CHILDREN], b[CHILDREN]), a[HINT] and b[HINT], a[FIXED] + b[FIXED]]


def _pairs(a: list, b: list, small: int = 1 << 12) -> list[tuple[int, int]]:
    """Increasing pairs of equal labels: a longest common subsequence where the table is small.

    In longer lists the n-th use of a label meets the n-th use in the other list, the longest
    increasing chain of such pairs stays, and the small gaps between its pairs are aligned exactly.
    """
    n, m = len(a), len(b)
    if n * m <= small:
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            for j in range(m - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
        out, i, j = [], 0, 0
        while i < n and j < m:
            if a[i] == b[j]:
                out.append((i, j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
        return out
    uses: dict[str, list[int]] = {}
    for j, label in enumerate(b):
        uses.setdefault(label, []).append(j)
    seen: dict[str, int] = {}
    ends: list[int] = []  # least last position in b of a chain of each length
    chains: list[tuple | None] = []
    for i, label in enumerate(a):
        use = seen[label] = seen.get(label, -1) + 1
        places = uses.get(label, ())
        if use < len(places):
            at = bisect.bisect_left(ends, places[use])
            link = (i, places[use], chains[at - 1] if at else None)
            ends[at:at + 1], chains[at:at + 1] = [places[use]], [link]
    chain, link = [], chains[-1] if chains else None
    while link:
        chain.append(link[:2])
        link = link[2]
    out, i, j = [], 0, 0
    for x, y in [*reversed(chain), (n, m)]:
        if i < x and j < y and (x - i) * (y - j) <= small:
            out += [(i + u, j + v) for u, v in _pairs(a[i:x], b[j:y], small)]
        out += [(x, y)] if x < n else []
        i, j = x + 1, y + 1
    return out


def _align(a: list[list], b: list[list]) -> list[list]:
    """Nodes of equal labels merged in order; the rest is optional."""
    left, right = [x[LABEL] for x in a], [x[LABEL] for x in b]
    if left == right:
        return [merge(x, y) for x, y in zip(a, b)]
    out, i, j = [], 0, 0
    for x, y in [*_pairs(left, right), (len(a), len(b))]:
        out += [[*n[:OPTIONAL], True, *n[OPTIONAL + 1:]] for n in a[i:x] + b[j:y]]
        out += [merge(a[x], b[y])] if x < len(a) and y < len(b) else []
        i, j = x + 1, y + 1
    return out


def copies(wrapper: list, paths: list[list[str]]) -> bool:
    """Whether a host's few pages share more of the article than differs: then they are copies of one page, and the shared text is the article."""
    nodes, slot, fixed = [], 0, 0
    for path in paths:
        at = [wrapper]
        for label in path:
            at = [c for n in at for c in n[CHILDREN] if c[LABEL] == label]
        nodes += at
    while nodes:
        node = nodes.pop()
        if not node[DROP]:
            slot, fixed = slot + node[CHARS], fixed + node[FIXED]
            nodes += node[CHILDREN]
    return wrapper[PAGES] < FEW and fixed > slot


def article_paths(wrapper: list) -> list[list[str]]:
    """Labels from the page down to each part that holds main text, judged by slot text.

    All ``main`` parts and the ``article`` parts outside them, if most pages have one, else the
    whole page. The descent goes on while one child holds all slot text, or each page has one
    of several such children at most (each is followed), and ends at an article tag.
    """
    sums: dict[int, int] = {}
    heads: set[int] = set()  # nodes with the page's own heading

    def total(node: list, hints: bool) -> int:
        inner = sum([total(c, hints) for c in node[CHILDREN]])
        if node[LABEL].partition(".")[0] == "h1" and node[CHARS] + inner or any(id(c) in heads for c in node[CHILDREN]):
            heads.add(id(node))
        off = node[DROP] or (hints and node[HINT] and id(node) not in heads)
        sums[id(node)] = 0 if off else node[CHARS] + inner
        return sums[id(node)]

    total(wrapper, True) or total(wrapper, False)

    def is_article(node: list) -> bool:
        return node[LABEL].partition(".")[0] == "article"

    def is_main(node: list) -> bool:
        tag, *names = node[LABEL].split(".")
        return tag == "main" or "@main" in names

    def topmost(top: list, way: list[str], test) -> list[tuple[list, list[str]]]:
        found, todo = [], [(top, way)]
        while todo:
            node, path = todo.pop()
            if sums[id(node)] and test(node):
                found.append((node, path))
            elif sums[id(node)]:
                todo += [(c, path + [c[LABEL]]) for c in node[CHILDREN]]
        return found if 2 * sum(n[PAGES] for n, _ in found) > top[PAGES] else []

    out, todo = [], [(wrapper, [], False)]
    while todo:
        node, path, marked = todo.pop()
        found = [] if marked else (topmost(node, path, lambda x: is_main(x) or is_article(x)) or topmost(node, path, lambda x: "main" in x[LABEL].split(".")))
        inner = [c for c in node[CHILDREN] if sums[id(c)]]
        if found:
            todo += [(n, way, True) for n, way in found]
        elif is_article(node) or node[CHARS] or not inner or (len(inner) == 1 and not inner[0][CHILDREN]) or sum(c[PAGES] for c in inner) > max(node[PAGES], inner[0][PAGES]):
            out.append(path)
        else:
            todo += [(c, path + [c[LABEL]], marked) for c in inner]
    return sorted(out)


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
RECORDS = frozenset("div li article".split())


def side_paths(wrapper: list, paths: list[list[str]]) -> list[list[str]]:
    """Labels down to the parts inside the article that the wrapper's groups show not to be its text.

    A hinted part goes if it, or a part in it, is repeated, or if it is optional. Without a hint
    a list goes that has the form of reader comments: optional, repeated, several slots in each
    record and no heading, after the article's text with nothing but such lists behind it. Nothing goes if only headings would stay.
    """
    gone: dict[tuple, bool] = {}
    kept: set[tuple] = set()

    def slots(node: list) -> int:
        return 0 if node[DROP] else (node[CHARS] > 0) + sum(slots(c) for c in node[CHILDREN])

    def has(node: list, test) -> bool:
        return test(node) or any(has(c, test) for c in node[CHILDREN])

    def walk(node: list, path: tuple, optional: bool, before: bool) -> bool:
        """Whether article text came before the end of this node."""
        kept.add(path)
        if node[CHARS] and path and path[-1].partition(".")[0] not in HEADINGS:
            before = True
            settle()
        for c in node[CHILDREN]:
            at, tag = (*path, c[LABEL]), c[LABEL].partition(".")[0]
            some = optional or c[OPTIONAL]
            if not slots(c):
                continue
            heading = has(c, lambda x: x[LABEL].partition(".")[0] in HEADINGS and x[CHARS])
            if c[HINT] and (c[OPTIONAL] or has(c, lambda x: x[REPEATED])) and not has(c, lambda x: x[LABEL].partition(".")[0] == "h1" and x[CHARS]):
                gone[at] = True
            elif before and some and c[REPEATED] and tag in RECORDS and not heading and slots(c) > 1:
                gone.setdefault(at, False)
            else:
                before = walk(c, at, some, before)
        return before

    def settle() -> None:
        """Article text follows: lists so far without a hint are part of the article."""
        kept.update(at for at, hinted in gone.items() if not hinted)

    before = False
    for path in paths:
        nodes = [wrapper]
        for label in path:
            nodes = [c for n in nodes for c in n[CHILDREN] if c[LABEL] == label]
        for node in nodes:
            before = walk(node, tuple(path), False, before)
    return sorted(list(at) for at in gone if at not in kept) if before else []


def blocks(page: str, paths: list[list[str]], known: set[str] | None = None, gone: list[list[str]] | None = None) -> list[str] | None:
    """Text blocks of the parts at ``paths``; None if the page has none of them.

    ``gone``: parts to leave out, as of ``side_paths``. ``known``: the fixed texts of the host, which are left out; without them (a host with one page) a strong hint counts alone.
    """
    out = []
    seen = whole = [] in paths
    nodes = [((0,) * len(paths), whole, False, "p", gone or [])]  # matched labels of each path, inside one, dropped, base of the texts, paths to leave out that lead here
    for kind, value, said in parts(page, known):
        depths, inside, off, base, ways = nodes[-1]
        if kind == "open":
            if not inside and not off:
                depths = tuple(d + (d < len(p) and value == p[d]) for d, p in zip(depths, paths))
            off |= said == OFF or (inside and known is None and said.startswith(STRONG))
            inside |= not off and any(d == len(p) for d, p in zip(depths, paths))
            seen |= inside and not off
            at = len(nodes)
            ways = [p for p in ways if len(p) >= at and p[at - 1] == value]
            off |= any(len(p) == at for p in ways)
            nodes.append((depths, inside, off, said if len(said) > 1 else base, ways))
        elif kind == "close":
            nodes.pop()
        elif inside and not off and not (known and _key(base, value) in known):
            out.append(value)
    return out if seen else None


def extract(page: str | None, paths: list[list[str]] | None, known: set[str] | None = None, gone: list[list[str]] | None = None) -> str:
    found = blocks(page, paths, known, gone) if page and paths is not None else None
    if found == [] and gone:
        found = blocks(page, paths, known)
    if found is None and page:
        found = blocks(page, article_paths(page_wrapper(page, known)), known)
    return "\n\n".join(found or [])


def _wrap(batches: Iterator[pd.DataFrame], most: int = 2000) -> Iterator[pd.DataFrame]:
    """Wrappers of the hosts of one partition; emitted early when there are ``most``."""
    held: dict[str, list] = {}

    def emit() -> pd.DataFrame:
        out = pd.DataFrame([(h, json.dumps(w)) for h, w in held.items()], columns=["host", "wrapper"])
        held.clear()
        return out

    for batch in batches:
        for host, page, known in zip(batch["host"], batch["html"], batch["known"]):
            one = page_wrapper(page, None if known is None else set(known))
            held[host] = merge(held[host], one) if host in held else one
        if len(held) >= most:
            yield emit()
    yield emit()


def _join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by host: each host's wrappers aligned into one, one host held at a time."""
    host, whole = None, None
    for batch in batches:
        out = []
        for name, wrapper in zip(batch["host"], batch["wrapper"]):
            if name != host:
                if whole is not None:
                    out.append((host, json.dumps(whole)))
                host, whole = name, None
            one = json.loads(wrapper)
            whole = merge(whole, one) if whole is not None else one
        yield pd.DataFrame(out, columns=["host", "wrapper"])
    if whole is not None:
        yield pd.DataFrame([(host, json.dumps(whole))], columns=["host", "wrapper"])


def host_wrappers(pages: DataFrame, salts: int = 16) -> DataFrame:
    """host, wrapper (nested lists as text) over all pages of the host."""
    schema = "host string, wrapper string"
    first = materialize(pages.where(F.col("html").isNotNull()).select("host", "html", "known").mapInPandas(_wrap, schema), "wrappers")
    salted = first.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts)))
    some = salted.repartition("host", "salt").sortWithinPartitions("host", "salt", "wrapper").select("host", "wrapper").mapInPandas(_join, schema)
    some = materialize(some, "wrappers")
    return some.repartition("host").sortWithinPartitions("host", "wrapper").mapInPandas(_join, schema)


def main_text(pages: DataFrame, *carry: str) -> DataFrame:
    """text and n_chars of every page, with the columns ``carry``."""
    kinds = {c: pages.schema[c].dataType for c in carry}
    host, _ = split_url(F.col("url"))
    df = pages.select(*[F.col(c).cast("string") for c in carry], host.alias("host"), "html")

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            wrappers = [json.loads(w) for w in batch["wrapper"]]
            paths = [article_paths(w) for w in wrappers]
            copied = [copies(w, p) for w, p in zip(wrappers, paths)]
            gone = [json.dumps([] if c else side_paths(w, p)) for w, p, c in zip(wrappers, paths, copied)]
            yield pd.DataFrame({"host": batch["host"], "path": [json.dumps(p) for p in paths], "gone": gone, "copied": copied})

    shared = materialize(host_facts(df), "hosts")
    paths = host_wrappers(df.join(shared, "host", "left")).mapInPandas(choose, "host string, path string, gone string, copied boolean").join(shared, "host", "left")
    paths = materialize(paths.withColumn("known", F.when(F.col("copied"), F.filter("known", lambda x: ~x.startswith("t:"))).otherwise(F.col("known"))), "paths")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [extract(h, None if p is None else json.loads(p), None if k is None else set(k), None if g is None else json.loads(g))
                     for h, p, k, g in zip(batch["html"], batch["path"], batch["known"], batch["gone"])]
            yield batch[list(carry)].assign(text=texts)

    schema = ", ".join([f"`{c}` string" for c in carry] + ["text string"])
    out = df.join(paths, "host", "left").select(*carry, "html", "path", "gone", "known").mapInPandas(read, schema)
    return out.select(*[F.col(c).cast(kinds[c]) for c in carry], "text", F.length("text").cast("long").alias("n_chars"))
