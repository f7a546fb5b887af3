"""HTML extraction: union-free wrappers, inferred by aligning the token streams of a host's pages.

A page's token stream is grouped by its balanced tags. Pages of one host are aligned one after another: groups that are
missing in some page become optional, groups that come more than once become repeated, groups whose order conflicts
become one repeated group of optional parts, and texts that differ become slots, while texts that never differ stay
literals. No mismatch is ever resolved into a choice between whole alternatives, so the wrapper is union-free and of
bounded size, and two wrappers align as a wrapper and a page do: partial wrappers are merged in rounds.
"""

from __future__ import annotations

import hashlib
import html as html_module
import json
import re
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.base import cut, drop_cut, small_batches

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
RAW = {"script", "style", "template", "noscript", "textarea", "iframe", "svg", "math", "title", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "head", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption",
}
#: An opening tag closes these if they are open above the nearest of the second set.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, {"select"})}
#: Groups that are never the article: by tag, by role, by a word of class or id.
BAD_TAGS = {"head", "nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "script", "style", "object", "canvas", "audio", "video", "label", "fieldset"}
BAD_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu", "menubar", "toolbar"}
BAD_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "aside", "widget",
    "header", "masthead", "footer", "foot", "cookie", "cookies", "consent", "gdpr", "notice", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "comment", "comments",
    "commentlist", "disqus", "respond", "reply", "replies", "share", "sharing", "social", "related", "recommended", "pagination", "pager", "toolbar", "skip", "copyright", "legal", "disclaimer", "paywall", "hidden",
}
#: A class or id that begins so says what its element has or has not, not what it is.
ABOUT = {"no", "non", "not", "has", "with", "without", "is", "hide", "hides"}
#: A class or id made of these words alone, one of TALK among them, names what readers wrote, whatever its tag.
TALK = {"comment", "comments", "commentlist", "disqus", "respond", "reply", "replies"}
TALK_PARTS = TALK | {"list", "lists", "area", "section", "box", "wrap", "wrapper", "container", "thread", "threads", "block", "item", "items", "body", "author", "content", "meta", "count", "counter", "form", "the", "user", "users", "reader", "readers", "div", "li", "all", "id", "text", "title", "template", "holder", "panel", "children", "inner", "outer", "main", "post"}
#: A name with such a word says how its element's comments are set, not that it holds them.
STATES = {"open", "closed", "enabled", "disabled", "on", "off", "allowed", "active"}
#: How sure it is that a group is no article: by its tag, role or style, or by words, which the wrapper may overrule.
SURE, PERHAPS = 2, 1
#: Alignment keeps at most so many different groups at one place, and so deep: beyond it the wrapper leaves out classes, or
#: takes what is deeper as text of the deepest group. Pages are read whole whatever the wrapper keeps.
MOST_KINDS, DEEPEST = 64, 60
#: A text is the template's if so many pages and such a share of the host's pages show it, always alike, and it is the smaller part.
LITERAL_PAGES, LITERAL_PART, LITERAL_SHARE = 2, 0.8, 0.5
#: Words are overruled where what is left without their group is a smaller part; in a page that would be empty, by a group with so many characters a page.
LEAST_LEFT, LONG_SLOT = 0.2, 400
#: A group is a menu if so much of its text is links, and it repeats them.
LINKS = 0.8
#: Wrappers of all hosts together may be broadcast up to this size; beyond it pages are joined with them by host.
BROADCAST_BYTES = 16 << 20
MERGE_BITS, MERGE_ROUNDS = 4, 3


class Group:
    """A balanced group of a page's tokens: key, tag, how sure it is no article, whether it is marked as one, and its texts and groups in order."""

    __slots__ = ("bad", "items", "key", "root", "tag")

    def __init__(self, key: str, tag: str, bad: int, root: bool):
        self.key, self.tag, self.bad, self.root, self.items = key, tag, bad, root, []


def no_article(value: str, root: bool) -> bool:
    """Whether a class or id names what is no article; of an element marked as one only if a name as a whole does."""
    for name in value.split():
        parts = [w for w in re.split(r"[^a-z]+", name) if w]
        if parts and parts[0] not in ABOUT and parts[-1] not in STATES and not BAD_WORDS.isdisjoint(parts) and (len(parts) == 1 or not root):
            return True
    return False


def talk(value: str) -> bool:
    """Whether a class or id names readers' comments."""
    names = ([w for w in re.split(r"[^a-z]+", name) if w] for name in value.split())
    return any(not TALK.isdisjoint(parts) and TALK_PARTS.issuperset(parts) for parts in names)


def opened(tag: str, attributes: str, in_article: bool) -> Group:
    """The group that a tag opens. A header inside an article is the article's own and holds its title."""
    sure, root, shown, names = tag in BAD_TAGS and not (tag == "header" and in_article), tag in ("article", "main"), "", []
    for m in ATTRIBUTE.finditer(attributes) if attributes.strip() else ():
        name, value = m[1].lower(), html_module.unescape(m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            names.append(value)
            if name == "class":
                shown = "." + ".".join(dict.fromkeys(w for w in re.split(r"[^a-z]+", value) if w))
        elif name == "role":
            sure |= value in BAD_ROLES
            root |= value in ("main", "article")
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            sure = True
    inner = tag not in ("html", "body")
    sure |= inner and any(map(talk, names))
    perhaps = inner and any(no_article(v, root) for v in names)
    if len(shown) > 60:  # a long name by its hash: the key only tells groups apart
        shown = "." + hashlib.blake2b(shown.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()
    return Group(tag + shown, tag, SURE if sure else PERHAPS if perhaps else 0, root)


def grouped(page: str) -> Group:
    """The page's token stream, grouped; unclosed and stray tags are put right as browsers do."""
    top = Group("", "", 0, False)
    stack, at, roots = [top], 0, 0

    def close(names: set[str], until: set[str]) -> None:
        nonlocal roots
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                roots -= sum(g.root for g in stack[k:])
                del stack[k:]
                return
            if stack[k].tag in until:
                return

    while m := TOKEN.search(page, at):
        if m.start() > at:
            stack[-1].items.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            close({tag}, {"table", "article", "body", "html"} - {tag} if tag not in ("table", "article", "body", "html") else set())
            continue
        if tag in BLOCK:
            close({"p"}, BLOCK - {"p"})
        if tag in CLOSES:
            close(*CLOSES[tag])
        group = opened(tag, m[3], roots > 0)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        stack[-1].items.append(group)
        if tag not in VOID and not m[3].rstrip().endswith("/"):
            stack.append(group)
            roots += group.root
    if at < len(page):
        stack[-1].items.append(page[at:])
    return top


def clean(text: str) -> str:
    return " ".join(html_module.unescape(text).split())


def all_texts(group: Group) -> list[str]:
    """The texts of a group and of all groups in it, in order."""
    out, todo = [], [group]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            out.append(item)
        else:
            todo.extend(reversed(item.items))
    return out


# A wrapper's group is a dict: n pages that have it, r repeated, b how sure it is no article, a marked as one, t
# characters of text, l those in links, q lacking in some coming of its group, x the hash of the literal text (None: a slot), s the text itself if it is short,
# o the order of its parts (a list of lists of keys; longer lists are repeated groups of optional parts), k the parts.


def of_page(group: Group, depth: int = 0, link: bool = False) -> dict:
    """The wrapper that matches one page only."""
    w = {"n": 1, "r": False, "b": group.bad, "a": group.root, "t": 0, "l": 0, "o": [], "k": {}}
    keys, texts = [], []
    link = link or group.tag == "a"
    many = len({g.key for g in group.items if isinstance(g, Group)}) > MOST_KINDS
    for item in group.items:
        if isinstance(item, str) or depth == DEEPEST:
            for text in [item] if isinstance(item, str) else all_texts(item):
                if t := clean(text):
                    texts.append(t)
                    keys.append("#")
            continue
        key = item.tag if many else item.key
        keys.append(key)
        part = of_page(item, depth + 1, link)
        w["k"][key] = aligned(w["k"][key], part, same_page=True) if key in w["k"] else part
    if texts:
        joined = "\n".join(texts)
        w["t"] += len(joined)
        digest = hashlib.blake2b(joined.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()
        w["k"]["#"] = {"n": 1, "r": len(texts) > 1, "b": 0, "a": False, "t": len(joined), "l": len(joined) if link else 0, "x": digest, "s": joined if len(joined) <= 60 else None, "o": [], "k": {}}
        w["l"] += w["k"]["#"]["l"]
    for k, p in w["k"].items():
        if k != "#":
            w["t"] += p["t"]
            w["l"] += p["l"]
    # parts between the first and the last coming of one key belong together
    spans: list[list] = []
    place: dict[str, list[int]] = {}
    for i, k in enumerate(keys):
        place.setdefault(k, [i, i])[1] = i
    for k, (a, b) in sorted(place.items(), key=lambda x: x[1]):
        if spans and a <= spans[-1][0]:
            spans[-1][0] = max(b, spans[-1][0])
            spans[-1][1].append(k)
        else:
            spans.append([b, [k]])
    w["o"] = [s[1] for s in spans]
    return w


def ordered(first: list[list[str]], second: list[list[str]]) -> list[list[str]]:
    """The order of parts that both orders agree with; parts on which they conflict share a place."""
    after: dict[str, set[str]] = {}
    rank: dict[str, int] = {}
    for order in (first, second):
        for i, parts in enumerate(order):
            for k in parts:
                rank.setdefault(k, len(rank))
                after.setdefault(k, set()).update(parts)
                if i + 1 < len(order):
                    after[k].update(order[i + 1])
    reach: dict[str, set[str]] = {}
    for k in after:
        seen, todo = set(), [k]
        while todo:
            for nxt in after[todo.pop()]:
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        reach[k] = seen
    left, out = set(after), []
    while left:
        free = min((k for k in left if all(k in reach[j] and j in reach[k] or j == k or k not in reach[j] for j in left)), key=rank.get)
        parts = sorted((j for j in left if j == free or (j in reach[free] and free in reach[j])), key=rank.get)
        out.append(parts)
        left -= set(parts)
    return out


def aligned(u: dict, v: dict, same_page: bool = False) -> dict:
    """The wrapper that matches what either matches."""
    w = {"n": max(u["n"], v["n"]) if same_page else u["n"] + v["n"], "r": same_page or u["r"] or v["r"], "b": max(u["b"], v["b"]), "a": u["a"] or v["a"], "t": u["t"] + v["t"], "l": u["l"] + v["l"]}
    if "x" in u or "x" in v:
        w["x"] = u.get("x") if u.get("x") == v.get("x") and not same_page else None
        w["s"] = u.get("s") if w["x"] is not None else None
    if u.get("q") or v.get("q"):
        w["q"] = True
    w["k"] = dict(u["k"])
    for k, part in v["k"].items():
        w["k"][k] = aligned(w["k"][k], part, same_page) if k in w["k"] else part
    if same_page:  # what one coming of a group has and the other lacks is optional, however many pages have it
        for k in u["k"].keys() ^ v["k"].keys():
            w["k"][k] = w["k"][k] | {"q": True}
    w["o"] = u["o"] if u["o"] == v["o"] else ordered(u["o"], v["o"])
    if len(w["k"]) > MOST_KINDS:
        w["k"], w["o"] = without_classes(w)
    return w


def without_classes(w: dict) -> tuple[dict, list]:
    kinds: dict[str, dict] = {}
    for k, part in w["k"].items():
        bare = k.split(".")[0]
        kinds[bare] = aligned(kinds[bare], part, same_page=True) if bare in kinds else part
    return kinds, [list(kinds)]


def expression(w: dict, key: str = "", pages: int | None = None) -> str:
    """The wrapper as a union-free regular expression: (...)? optional, (...)+ repeated, # a slot, other text a literal."""
    if key == "#":
        body = "#" if w.get("x") is None else w["s"] if w.get("s") is not None else f"[{w['x']}]"
    else:
        parts = []
        for group in w["o"]:
            inner = "".join(expression(w["k"][k], k, w["n"] if len(group) == 1 else 1 << 60) for k in group if k in w["k"])
            parts.append(f"({inner})+" if len(group) > 1 else inner)
        body = f"<{key}>{''.join(parts)}</{key.split('.')[0]}>" if key else "".join(parts)
    mark = ("*" if w["r"] else "?") if pages is not None and (w["n"] < pages or w.get("q")) else "+" if w["r"] else ""
    return f"({body}){mark}" if mark else body


def rules(w: dict, pages: int) -> dict:
    """What the wrapper tells extraction: root, whether articles are marked; and the paths of

    literals: texts of the template, where no article is marked (in a marked one text that all pages share is the article's); keep: groups that words speak against but that hold the host's text; long: such
    that hold a page's text where nothing else does; menus: groups of repeated links, where no article is marked.
    """
    keep: set[str] = set()

    def visible(part: dict, path: str, inside: bool, marked: bool) -> int:
        """Characters of slots and literals that extraction would take."""
        inside = inside or part["a"]
        return sum(sub["t"] if k == "#" and (inside or not marked) else 0 if k == "#" or hidden(sub, f"{path}/{k}") else visible(sub, f"{path}/{k}", inside, marked) for k, sub in part["k"].items())

    def hidden(part: dict, path: str) -> bool:
        return part["b"] == SURE or (part["b"] == PERHAPS and path not in keep)

    def has_root(part: dict, path: str) -> bool:
        return any(k != "#" and not hidden(sub, f"{path}/{k}") and (sub["a"] or has_root(sub, f"{path}/{k}")) for k, sub in part["k"].items())

    def doubtful(part: dict, path: str) -> list[tuple[int, str, dict]]:
        """The uppermost groups that only words speak against."""
        out = []
        for k, sub in part["k"].items():
            at = f"{path}/{k}"
            if k == "#" or sub["b"] == SURE:
                continue
            out += [(visible(sub, at, True, False), at, sub)] if hidden(sub, at) else doubtful(sub, at)
        return out

    while groups := doubtful(w, ""):
        most, path, _ = max(groups, key=lambda g: (g[0], g[1]))
        left = visible(w, "", False, has_root(w, ""))
        if not most or left >= LEAST_LEFT * (left + most):
            break
        keep.add(path)
    root = has_root(w, "")
    body = max(1, visible(w, "", False, root))
    literals, menus, slots = [], [], [0]

    def varies(part: dict) -> bool:
        """Whether the group's own block, without blocks in it, has a slot."""
        return any(sub.get("x") is None if k == "#" else k.split(".")[0] not in BLOCK and varies(sub) for k, sub in part["k"].items())

    def walk(part: dict, path: str, inside: bool, slot: bool) -> None:
        inside = inside or part["a"]
        for k, sub in part["k"].items():
            at = f"{path}/{k}"
            if k == "#":
                if not root and not slot and sub.get("x") is not None and sub["n"] >= max(LITERAL_PAGES, LITERAL_PART * pages) and sub["t"] <= LITERAL_SHARE * body:
                    literals.append(path)
                elif inside or not root:
                    slots[0] += sub["t"] if sub.get("x") is None else 0
            elif not hidden(sub, at):
                if not root and sub["t"] and sub["l"] >= LINKS * sub["t"] and sub["tag_links"] > 1:
                    menus.append(at)
                else:
                    walk(sub, at, inside, varies(sub) if k.split(".")[0] in BLOCK else slot)

    count_links(w)
    walk(w, "", False, varies(w))
    long = [p for t, p, part in doubtful(w, "") if t >= LONG_SLOT * part["n"] and part["l"] <= 0.3 * part["t"] and not part["r"]]
    # pages that never differ say nothing on what is the template
    return {"root": root, "literals": literals if slots[0] else [], "keep": sorted(keep), "long": long, "menus": menus}


def count_links(w: dict, key: str = "") -> int:
    """Sets tag_links of every group: 2 if it holds links more than once, 1 or 0 if once or none."""
    n = 2 if key.split(".")[0] == "a" and w["r"] else 1 if key.split(".")[0] == "a" else 0
    inner = [count_links(sub, k) for k, sub in w["k"].items() if k != "#"]
    w["tag_links"] = min(2, n + sum(inner) * (2 if w["r"] else 1))
    return w["tag_links"]


def extracted(top: Group, rule: dict) -> str:
    """Article text of a grouped page: blocks in order, by the host's rules."""
    text = taken(top, rule, set(rule["keep"]))
    return text if text or not rule["long"] else taken(top, rule, {*rule["keep"], *rule["long"]})


def taken(top: Group, rule: dict, keep: set[str]) -> str:
    """Without recursion, so that pages may nest as deep as they like. Every text is decoded by itself."""
    literals, menus = set(rule["literals"]), set(rule["menus"])
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if t := " ".join("".join(line).split()):
            blocks.append(t)
        line.clear()

    def paths(g: Group, path: str) -> list[tuple[object, str]]:
        many = len({x.key for x in g.items if isinstance(x, Group)}) > MOST_KINDS
        return [(x, path if isinstance(x, str) else f"{path}/{x.tag if many else x.key}") for x in g.items]

    def hidden(g: Group, path: str) -> bool:
        return g.bad == SURE or (g.bad == PERHAPS and path not in keep) or path in menus

    only, todo = False, paths(top, "") if rule["root"] else []
    while todo and not only:
        item, path = todo.pop()
        if not isinstance(item, str) and not hidden(item, path):
            only = item.root
            todo += paths(item, path)
    # (item, path, inside an article, whether a block ends here)
    walk = [(x, p, not only, False) for x, p in reversed(paths(top, ""))]
    while walk:
        item, path, inside, ends = walk.pop()
        if ends:
            flush()
        elif isinstance(item, str):
            if inside and path not in literals:
                line.append(html_module.unescape(item))
        elif hidden(item, path):
            if item.tag in BLOCK:
                flush()
        else:
            if item.tag in BLOCK:
                flush()
                walk.append((item, path, inside, True))
            elif item.tag == "br":
                line.append(" ")
            walk += [(x, p, inside or item.root, False) for x, p in reversed(paths(item, path))]
    flush()
    return "\n".join(blocks)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def packed(w: dict) -> bytes:
    return zlib.compress(json.dumps(w, separators=(",", ":"), ensure_ascii=False).encode("utf-8", "surrogatepass"), 1)


def unpacked(b: bytes) -> dict:
    return json.loads(zlib.decompress(b).decode("utf-8", "surrogatepass"))


_WRAPPERS = "host string, run int, pages long, wrapper binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["host", "run", "pages", "wrapper"])


#: Hosts whose wrappers a task keeps at most; it then sends them and begins anew.
HOSTS_HELD = 2_000


def _inferred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partial wrapper per host, as runs numbered by the task; one for a host and HOSTS_HELD hosts."""
    run, hosts = TaskContext.get().partitionId(), {}
    for batch in batches:
        for url, page in zip(batch.column("url").to_pylist(), batch.column("html"), strict=True):
            w, host = of_page(grouped(page.as_py() or "")), host_of(url)
            have = hosts.get(host)
            hosts[host] = [have[0] + 1, aligned(have[1], w)] if have else [1, w]
        if len(hosts) >= HOSTS_HELD:
            yield _batch([(h, run, n, packed(w)) for h, (n, w) in hosts.items()])
            hosts = {}
    if hosts:
        yield _batch([(h, run, n, packed(w)) for h, (n, w) in hosts.items()])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (host, run): one wrapper for each, the run's number divided for the next round."""
    at, pages, have = None, 0, None
    for batch in batches:
        out = []
        for host, run, n, w in zip(*(batch.column(c).to_pylist() for c in ("host", "run", "pages", "wrapper")), strict=True):
            if (host, run) != at:
                if at is not None:
                    out.append((at[0], at[1] >> MERGE_BITS, pages, packed(have)))
                at, pages, have = (host, run), n, unpacked(w)
            else:
                pages, have = pages + n, aligned(have, unpacked(w))
        yield _batch(out)
    if at is not None:
        yield _batch([(at[0], at[1] >> MERGE_BITS, pages, packed(have))])


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, pages, wrapper (compressed JSON) over all pages of each host.

    Runs of one host meet in rounds of 2**MERGE_BITS, so a host with a third of all pages is merged from as many
    small wrappers as there were tasks, never from its pages in one task.
    """
    runs = pages.select(F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(_inferred, _WRAPPERS)
    runs = runs.withColumn("run", F.shiftright("run", MERGE_BITS))
    for k in range(MERGE_ROUNDS):
        if k == MERGE_ROUNDS - 1:
            runs = runs.withColumn("run", F.lit(0))
        runs = runs.repartition("host", "run").sortWithinPartitions("host", "run", "pages", "wrapper").mapInArrow(_merged, _WRAPPERS)
    return runs.select("host", "pages", "wrapper")


def _ruled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        r = [json.dumps(rules(unpacked(w), n)) for w, n in zip(batch.column("wrapper").to_pylist(), batch.column("pages").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(r, pa.string())], names=["rule_host", "rule"])


def _hosted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        urls = batch.column("url")
        body = [zlib.compress((h.as_py() or "").encode("utf-8", "surrogatepass"), 1) for h in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), urls, pa.array([host_of(u) for u in urls.to_pylist()], pa.string()), pa.array(body, pa.binary())], names=["page_id", "url", "host", "body"])


def _texts(batches: Iterator[pa.RecordBatch], by_host: dict[str, str] | None = None) -> Iterator[pa.RecordBatch]:
    known: dict[str, dict] = {}
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            if by_host is None:
                page, rule = zlib.decompress(batch.column("body")[i].as_py()).decode("utf-8", "surrogatepass"), batch.column("rule")[i].as_py()
            else:
                page, rule = batch.column("html")[i].as_py() or "", by_host[host_of(batch.column("url")[i].as_py())]
            if rule not in known:
                known = known if len(known) < 10_000 else {}
                known[rule] = json.loads(rule)
            out.append(extracted(grouped(page), known[rule]))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages.

    Null html is an empty page with an empty text; pages without a usable url share one host of their own. Repeated rows
    count as pages each and give equal texts. An empty table gives an empty result; other columns are ignored; pages may be
    of any length and depth. What a page shows inside the groups that the wrapper's host marks as articles is its text, or
    inside its body where it marks none, without groups that are no article by tag, role or style, and without the
    wrapper's literals. Words of classes and ids speak against a group unless the host's wrapper has its text there. The
    rules of all hosts are small; they go to every task if they are under broadcast_bytes together, else pages are
    joined with them by host, compressed, and Spark splits a hot host.
    """
    rows = small_batches(pages).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    wrappers = infer_wrappers(rows)
    ruled = cut(wrappers.mapInArrow(_ruled, "rule_host string, rule string"), "wrappers")
    size = ruled.agg(F.coalesce(F.sum(F.length("rule_host") + F.length("rule") + 64), F.lit(0))).first()[0]
    schema = "page_id long, url string, text string, n_chars long"
    if size <= broadcast_bytes:
        table = {r["rule_host"]: r["rule"] for r in ruled.collect()}
        drop_cut(ruled)
        return rows.mapInArrow(_bound(table), schema)
    hosted = rows.mapInArrow(_hosted, "page_id long, url string, host string, body binary")
    joined = hosted.join(ruled, F.col("host") == F.col("rule_host")).select("page_id", "url", "body", "rule")
    return joined.mapInArrow(_bound(None), schema)


def _bound(table: dict[str, str] | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _texts(batches, table)

    return run


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
