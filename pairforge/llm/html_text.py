"""Main text of web pages by union-free regular expressions of their hosts.

All different pages of a host are read as streams of block tags and texts.
The first page is the wrapper; every further page is aligned with it, and
mismatches are resolved as in union-free grammar inference: two different
texts become a slot, a run of equal siblings a repeated group, and tokens that
one side lacks an optional group. A slot counts its most frequent texts (Misra
and Gries, ``MAX_COUNTERS``, merged with the slots). The
wrapper then tells where a host's varying text lies: the innermost container,
outside menus, notices and the like, with most of it is the main region, and
so is every other container beside it with at least ``LEAST_SHARE`` of it.
Texts that are the same on ``TEMPLATE_SHARE`` of the different pages (none below
that share; all above 0.912, or of up to 8 texts in a slot) do not vary, and those of them outside paragraphs and headings are the template's if a
count over all pages of the host agrees (``COMMON_SHARE`` of them). A page's
main text is the blocks of the main regions without menus, headers, footers,
sidebars, notices, adverts, forms, comments, scripts and template texts. A
page of which the regions hold less than ``PAGE_SHARE`` (a rarer template), or
whose host has one page only, is cut by its own wrapper.

Class names that also name ordinary containers (``SOFT_WORDS``) drop an element
only while the rest of the host's pages holds more text than such elements.

Every page is parsed in the task that reads it and leaves its tokens (texts
above ``MAX_TEXT`` as digests), whose copies are merged. Wrappers of about
``FAN_IN`` pages are inferred first, in the order of a hash of the page, then
the wrappers of those, level by level, so a host of any size is no group of its
own. A wrapper above ``MAX_ALIGN_TOKENS`` tokens joins those of one path, then
counts the deepest for their parents; no page is left out. Finished wrappers are broadcast while they
stay under ``MAX_BROADCAST_BYTES``, else joined by host.

Defined results: null and empty html give an empty text; a null url belongs
to the host ''; repeated rows are each extracted; an unclosed element ends
with its parent; no text is cut short; other columns are dropped.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import Counter
from difflib import SequenceMatcher

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairforge.llm.registry import register, table
from pairforge.llm.url_rules import split_url
from pairforge.session import materialize

FAN_IN = 64
MAX_BROADCAST_BYTES = 64_000_000
MAX_ALIGN_TOKENS = 1_000
MAX_TEXT = 64
MAX_COUNTERS = 8

LEAST_SHARE = 0.2
PAGE_SHARE = 0.6
COMMON_SHARE = 0.5
TEMPLATE_SHARE = 0.9

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|svg|textarea|title|iframe|object|select|math)\b(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*>|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)|(?P<text>[^<]+|<)", re.S | re.I)
ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPACE = re.compile(r"\s+")

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr label input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose end tag may be missing: one ends where a sibling starts.
IMPLIED = {"p": "p", "li": "li", "dt": "d", "dd": "d", "tr": "tr", "td": "c", "th": "c", "option": "o"}
DROP_TAGS = frozenset("nav footer aside form button dialog menu head".split())
DROP_WORDS = frozenset((
    "ad ads advert adverts advertisement advertising banner banners sponsor sponsored promo promotion nav navbar navigation "
    "menu breadcrumb breadcrumbs sidebar aside footer header masthead cookie cookies consent gdpr notice notices alert popup "
    "modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "comment comments reply replies respond responses disqus discussion widget toolbar pagination pager skip search "
    "complementary contentinfo dialog disclaimer copyright").split())
SOFT_WORDS = frozenset("widget overlay modal share sharing social search skip toolbar alert header masthead related recommended response responses".split())
KEEP, SOFT, HARD = 0, 1, 2
KEEP_ALWAYS = frozenset("html body main article".split())
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p li blockquote pre td dd dt figcaption".split())
REGIONS = frozenset("article main section div td body".split())


def _key(name: str, attrs: str) -> tuple[str, frozenset]:
    """Signature of an opening tag (name and class or id) and the words of its class, id and role."""
    if not attrs or "=" not in attrs:
        return name, frozenset()
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in ATTR.finditer(attrs)}
    words = frozenset(w for v in found.values() for w in re.split(r"[^a-z0-9]+", v) if w)
    mark = found.get("class") or found.get("id")
    return (f"{name}.{' '.join(mark.split())}" if mark else name), words


def _dropped(name: str, words: frozenset, inside: bool) -> int:
    """KEEP, SOFT (by a class name that main text may have, too) or HARD."""
    if name in DROP_TAGS or (name == "header" and not inside):
        return HARD
    if name in KEEP_ALWAYS:
        return HARD if name == "article" and words & {"comment", "comments", "reply", "related", "ad", "advert"} else KEEP
    hit = words & DROP_WORDS
    return KEEP if not hit else SOFT if hit <= SOFT_WORDS else HARD


def blocks(page: str | None):
    """The page as blocks: (path of open elements, text, characters inside links, KEEP, SOFT or HARD).

    The path holds a signature for each open block element; white space in a
    text is one space, and character references are decoded.
    """
    out, stack = [], []  # stack: (name, signature, dropped)
    text, linked, links = [], 0, 0

    def flush():
        nonlocal text, linked
        t = SPACE.sub(" ", "".join(text)).strip()
        if t:
            out.append((tuple(s for _, s, _ in stack), t, linked, stack[-1][2] if stack else KEEP))
        text, linked = [], 0

    for m in TOKEN.finditer(page or ""):
        if m["text"] is not None:
            t = entities.unescape(m["text"])
            text.append(t)
            linked += len(t.strip()) if links else 0
            continue
        if not m["name"]:
            continue
        name = m["name"].lower()
        if name == "br":
            text.append(" ")
        elif name in INLINE:
            links = max(0, links + (-1 if m["close"] else 1)) if name == "a" else links
        elif m["close"]:
            flush()
            links = 0
            if name == "body" or name == "html":
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
        else:
            flush()
            links = 0
            if name in VOID:
                continue
            if name in IMPLIED:
                for i in range(len(stack) - 1, -1, -1):
                    if IMPLIED.get(stack[i][0]) == IMPLIED[name]:
                        del stack[i:]
                        break
                    if stack[i][0] not in IMPLIED:
                        break
            elif stack and stack[-1][0] == "p":
                stack.pop()
            sign, words = _key(name, m["attrs"])
            inside = any(n in ("article", "main") for n, _, _ in stack)
            stack.append((name, sign, max(stack[-1][2] if stack else KEEP, _dropped(name, words, inside))))
    flush()
    return out


def mark(text: str) -> str:
    """A text as wrappers know it: itself, or the digest of one above MAX_TEXT characters."""
    return text if len(text) <= MAX_TEXT else "\0" + hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()


def stream(page_blocks) -> list[dict]:
    """Blocks as wrapper tokens: runs of equal siblings are one repeated group.

    ``texts`` are the texts found at a token outside such runs: pages that have it there and its characters.
    """
    out: list[dict] = []
    for path, t, linked, drop in page_blocks:
        key = "/".join(path)
        chars = len(t) - 2 * linked
        if out and out[-1]["key"] == key and path and path[-1].split(".")[0] in ("p", "li", "tr", "td", "dd", "dt", "h2", "h3"):
            out[-1].update(kind="repeat", texts={}, chars=out[-1]["chars"] + chars)
        else:
            out.append({"key": key, "kind": "text", "texts": {mark(t): [1, chars]}, "chars": chars, "drop": drop, "optional": False})
    return out


def _joined(n: dict, t: dict) -> dict:
    """One token for two that are aligned."""
    same = n["kind"] == "text" and t["kind"] == "text" and n["texts"].keys() == t["texts"].keys()
    kind = "text" if same else "repeat" if "repeat" in (n["kind"], t["kind"]) else "slot"
    texts = dict(n["texts"])
    for text, (pages, chars) in t["texts"].items():
        texts[text] = [pages + texts[text][0], texts[text][1]] if text in texts else [pages, chars]
    if len(texts) > MAX_COUNTERS:
        less = sorted((p for p, _ in texts.values()), reverse=True)[MAX_COUNTERS]
        texts = {k: [p - less, c] for k, (p, c) in texts.items() if p > less}
    return n | {"kind": kind, "texts": texts, "chars": n["chars"] + t["chars"], "optional": n["optional"] or t["optional"]}


def align(wrapper: list[dict], tokens: list[dict]) -> list[dict]:
    """The wrapper generalised so that it also fits ``tokens``, those of a page or another wrapper."""
    a, b = [n["key"] for n in wrapper], [t["key"] for t in tokens]
    if a == b:
        return [_joined(n, t) for n, t in zip(wrapper, tokens, strict=True)]
    out = []
    for op, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op == "equal":
            out += [_joined(n, t) for n, t in zip(wrapper[i:j], tokens[k:m], strict=True)]
        else:
            out += [n | {"optional": True} for n in [*wrapper[i:j], *tokens[k:m]]]
    return out


def bounded(tokens: list[dict]) -> list[dict]:
    """At most MAX_ALIGN_TOKENS tokens with the same characters in all: tokens of one path become one repeated group,
    and while that is not enough the deepest count for their parents."""
    cut = None
    while len(tokens) > MAX_ALIGN_TOKENS:
        one: dict[tuple, dict] = {}
        for t in tokens:
            if cut is not None and t["key"].count("/") >= cut:
                t = t | {"key": t["key"].rsplit("/", 1)[0], "kind": "repeat", "texts": {}}
            n = one.get((t["key"], t["drop"]))
            one[t["key"], t["drop"]] = t if n is None else n | {
                "kind": "repeat", "texts": {}, "chars": n["chars"] + t["chars"], "optional": n["optional"] and t["optional"]}
        tokens = list(one.values())
        cut = max(t["key"].count("/") for t in tokens)
        if not cut:
            break
    return tokens


def _regions(tokens: list[tuple[tuple, int]], whole: int, share: float = 0.6) -> list[tuple]:
    """The innermost container with most (0.6) of the text, then those beside it that hold at least LEAST_SHARE of all
    (half of it, where marked up as article or main)."""
    out: list[tuple] = []
    while tokens:
        mass: dict[tuple, int] = {}
        for parts, chars in tokens:
            for i, part in enumerate(parts):
                if part.split(".")[0] in REGIONS:
                    mass[parts[:i + 1]] = mass.get(parts[:i + 1], 0) + chars
        # A container around a region found already is no region beside it.
        mass = {r: m for r, m in mass.items() if not any(o[:len(r)] == r for o in out)}
        named = {r: m for r, m in mass.items() if r[-1].split(".")[0] in ("article", "main")}
        top = max(mass.values(), default=0)
        # A region marked up as article or main needs half the share.
        marked = max(named.values(), default=0)
        if not top or out and top < LEAST_SHARE * whole and marked < LEAST_SHARE / 2 * whole:
            break
        use = named if marked >= 0.3 * top or out and top < LEAST_SHARE * whole else mass
        best = max((r for r, m in use.items() if m >= share * max(use.values())), key=lambda r: (len(r), mass[r], r))
        if out and mass[best] < (LEAST_SHARE / 2 if use is named else LEAST_SHARE) * whole:
            break
        out.append(best)
        if use is named and len(out) == 1:
            # Where main text is marked up as such, only other marked regions are main text.
            tokens = [(p, c) for p, c in tokens if any(x.split(".")[0] in ("article", "main") for x in p)]
        tokens = [(p, c) for p, c in tokens if p[:len(best)] != best]
    return out


def infer(pages: list[str]) -> dict:
    """Wrapper of a host's pages: {"regex", "main" and "mains": paths of the main regions, "fixed": template texts,
    "soft": whether elements of soft class names are main text, "pages"}."""
    return _inferred([stream(blocks(page)) for page in pages])


def _inferred(streams: list[list[dict]]) -> dict:
    wrapper: list[dict] | None = None
    used = 0
    for tokens in streams:
        if tokens:
            used += 1
            wrapper = bounded(tokens) if wrapper is None else bounded(align(wrapper, bounded(tokens)))
    return finished(wrapper or [], used)


def finished(wrapper: list[dict], used: int) -> dict:
    """The wrapper of ``used`` different pages (see :func:`infer`)."""
    often = [next(((t, p * c) for t, (p, c) in n["texts"].items() if p >= TEMPLATE_SHARE * used), (None, 0)) for n in wrapper]
    varying = [(n, max(0, n["chars"] - (held if used > 1 else 0))) for n, (_, held) in zip(wrapper, often, strict=True) if used < 2 or n["kind"] != "text"]
    held = {level: sum(c for n, c in varying if n["drop"] == level) for level in (KEEP, SOFT)}
    soft = held[SOFT] > held[KEEP]
    tokens = [(tuple(n["key"].split("/")), c) for n, c in varying if n["drop"] <= (SOFT if soft else KEEP)]
    mains = ["/".join(r) for r in _regions(tokens, sum(c for _, c in tokens))]
    # Headings and paragraphs stay even if all pages share them (near copies of one article).
    fixed = sorted({t for n, (t, _) in zip(wrapper, often, strict=True) if t
                    and n["key"].split("/")[-1].split(".")[0] not in PROSE}) if used >= 4 else []
    show = {"text": lambda n: re.escape(next(iter(n["texts"]))), "slot": lambda n: "#", "repeat": lambda n: "(#)+"}
    regex = "".join(f"{'(' if n['optional'] else ''}<{n['key']}>{show[n['kind']](n)}{')?' if n['optional'] else ''}" for n in wrapper)
    return {"regex": regex, "main": mains[0] if mains else None, "mains": mains, "fixed": fixed, "soft": soft, "pages": used}


def extract(page: str | None, wrapper: dict | None) -> str:
    """Main text: the kept blocks of the wrapper's main regions, one per line."""
    found = blocks(page)
    best, mass = "", 0
    for w in (wrapper, None):
        if w is None:
            w = _inferred([stream(found)])
        fixed, most = set(w["fixed"]), SOFT if w["soft"] else KEEP
        mains = [tuple(m.split("/")) for m in w["mains"]]
        got = [(t, linked) for path, t, linked, drop in found if drop <= most and not (fixed and mark(t) in fixed) and any(path[:len(m)] == m for m in mains)]
        held = sum(max(0, len(t) - 2 * linked) for t, linked in got)
        if got and (not best or held > mass):
            best, mass = "\n".join(t for t, _ in got), held
        # The page's own text outside dropped elements: enough of it is in the regions, or the page is cut by itself.
        whole = sum(max(0, len(t) - 2 * linked) for _, t, linked, drop in found if drop <= most and not (fixed and mark(t) in fixed))
        softer = sum(max(0, len(t) - 2 * linked) for _, t, linked, drop in found if drop == SOFT)
        if got and held >= PAGE_SHARE * whole and (w["soft"] or softer <= held):
            break
    return best


def _folded(rows: DataFrame, parts: int) -> DataFrame:
    """(host, h, pages, tokens), one wrapper for the rows of a host in each of ``parts`` ranges of ``h``, aligned in its order."""
    part = F.least(F.floor((F.col("h") / F.lit(2.0**64) + F.lit(0.5)) * parts), F.lit(parts - 1))

    def run(frames):
        import pandas as pd
        out, at, wrapper, first, n = [], None, None, None, 0
        for f in frames:
            for host, p, h, pages, tokens in zip(f["host"], f["part"], f["h"], f["pages"], f["tokens"], strict=True):
                tokens = bounded(json.loads(tokens))
                if at == (host, p):
                    wrapper, n = bounded(align(wrapper, tokens)), n + pages
                    continue
                if at is not None:
                    out.append((at[0], first, n, json.dumps(wrapper)))
                at, wrapper, first, n = (host, p), tokens, h, pages
                if len(out) >= 64:
                    yield pd.DataFrame(out, columns=["host", "h", "pages", "tokens"])
                    out = []
        if at is not None:
            out.append((at[0], first, n, json.dumps(wrapper)))
        if out:
            yield pd.DataFrame(out, columns=["host", "h", "pages", "tokens"])

    rows = rows.withColumn("part", part).repartition("host", "part").sortWithinPartitions("host", "part", "h")
    return rows.mapInPandas(run, "host string, h long, pages long, tokens string")


def learn_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", fan_in: int = FAN_IN) -> DataFrame:
    """(host, wrapper as JSON) from all different pages of each host, ``fan_in`` of them or of their wrappers at a time."""
    host = split_url(url_col)[0]
    rows = pages.where(F.col(html_col).isNotNull()).select(host.alias("host"), F.xxhash64(html_col).alias("h"), F.col(html_col).alias("html"))

    def parse(frames):
        import pandas as pd
        for f in frames:
            f = f.drop_duplicates(["host", "h"])
            found = [(host, h, json.dumps(t)) for host, h, page in zip(f["host"], f["h"], f["html"], strict=True) if (t := stream(blocks(page)))]
            yield pd.DataFrame(found, columns=["host", "h", "tokens"])

    # Copies of a page have the same tokens.
    different = materialize(rows.mapInPandas(parse, "host string, h long, tokens string")
                            .groupBy("host", "h").agg(F.min("tokens").alias("tokens")), "page-tokens")
    most = different.groupBy("host").count().agg(F.max("count")).first()[0] or 1
    found, parts = different.withColumn("pages", F.lit(1).cast("long")), most
    while True:
        parts = -(-parts // fan_in)
        found = _folded(found, parts)
        if parts == 1:
            break

    def finish(frames):
        import pandas as pd
        for f in frames:
            yield pd.DataFrame({"host": f["host"], "wrapper": [json.dumps(finished(json.loads(t), n)) for t, n in zip(f["tokens"], f["pages"], strict=True)]})

    return materialize(found.mapInPandas(finish, "host string, wrapper string"), "wrappers")


def _with_wrappers(rows: DataFrame, wrappers: DataFrame, max_broadcast: int, use, schema: str) -> DataFrame:
    """``use(pages of a batch with their wrappers)`` over all ``rows``; wrappers are broadcast up to ``max_broadcast`` bytes, else joined by host."""
    size = wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0
    known = None
    if size <= max_broadcast:
        known = rows.sparkSession.sparkContext.broadcast({r.host: r.wrapper for r in wrappers.collect()})
        rows = rows.withColumn("wrapper", F.lit(None).cast("string"))
    else:
        rows = rows.join(wrappers, "host", "left")

    def run(frames):
        ready: dict = {}
        for f in frames:
            own = []
            for host, w in zip(f["host"], f["wrapper"], strict=True):
                if host not in ready:
                    if len(ready) > 10_000:
                        ready.clear()
                    w = known.value.get(host) if known else w
                    ready[host] = json.loads(w) if w else None
                own.append(ready[host])
            yield use(f, own)

    return rows.select("id", "url", "html", "host", "wrapper").mapInPandas(run, schema)


def agreed(rows: DataFrame, wrappers: DataFrame, max_broadcast: int) -> DataFrame:
    """The wrappers with those template texts only that at least COMMON_SHARE of all pages of the host hold.

    Pages are read again for hosts that have any; counts are added up per batch, so a host's pages need not meet.
    """
    def count(f, own):
        import pandas as pd
        n: Counter = Counter()
        for page, host, w in zip(f["html"], f["host"], own, strict=True):
            if w and w["fixed"]:
                n[host, None] += 1
                n.update((host, t) for t in {mark(t) for _, t, _, _ in blocks(page)}.intersection(w["fixed"]))
        return pd.DataFrame({"host": pd.Series([h for h, _ in n], dtype=object), "t": pd.Series([t for _, t in n], dtype=object),
                             "n": pd.Series(list(n.values()), dtype="int64")})

    n = _with_wrappers(rows, wrappers, max_broadcast, count, "host string, t string, n long").groupBy("host", "t").agg(F.sum("n").alias("n"))
    pages = n.where("t is null").select("host", F.col("n").alias("pages"))
    good = (n.where("t is not null").join(pages, "host").where(F.col("n") >= F.lit(COMMON_SHARE) * F.col("pages"))
            .groupBy("host").agg(F.collect_list("t").alias("good")))

    def keep(frames):
        for f in frames:
            f["wrapper"] = [json.dumps({k: v for k, v in json.loads(w).items() if k != "regex"} | {"fixed": sorted(g) if g is not None else []}) for w, g in zip(f["wrapper"], f["good"], strict=True)]
            yield f[["host", "wrapper"]]

    return materialize(wrappers.join(good, "host", "left").mapInPandas(keep, "host string, wrapper string"), "wrappers-agreed")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  fan_in: int = FAN_IN, max_broadcast: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """id, url, ``text`` for each row of ``pages``."""
    wrappers = learn_wrappers(pages, url_col, html_col, fan_in)
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
                        split_url(url_col)[0].alias("host"))
    wrappers = agreed(rows, wrappers, max_broadcast)

    def cut(f, own):
        import pandas as pd
        return pd.DataFrame({"id": f["id"], "url": f["url"], "text": [extract(page, w) if page else "" for page, w in zip(f["html"], own, strict=True)]})

    return _with_wrappers(rows, wrappers, max_broadcast, cut, f"id {kind}, url string, text string").withColumnRenamed("id", id_col)


@register("op9_union_free_wrappers")
def op9(spark, sf_dir):
    out = extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
