"""Main text of web pages, by templates deduced from equivalence classes of tokens.

A page is read as a sequence of tokens: block-level tags, each with the path of elements around it, and text blocks, each
with its path and a hash of its text. On one host, tokens with the same occurrence vector (as often on the same pages)
form an equivalence class; classes with enough tokens on enough pages (a share of those with tokens, so an error page or a
second layout hides nothing), in the same order everywhere, belong to the template. Classes nest: an element around all of
a class' tokens must belong to a class on as many pages or more. What template text leaves open are slots, named by their
paths.

1. One Arrow pass gives (host, token, occurrences) rows. An occurrence vector is never built: its fingerprint is the exclusive
   or of hash(page, occurrences), an aggregate that is combined before the shuffle, so a host with a third of all pages
   is no harder than others.
2. Aggregates by host over the token table: classes, the order of their tokens on every page, the elements around them; then
   the text blocks of the classes that hold, and the path around all slots with a fair share of the text.
3. A second pass extracts: a page's blocks without those of the template are its slots, whatever its elements are. Names come
   after: no parts whose element, role or class name says that they are menus, adverts, forms, comments and the like; where
   a slot lies in an <article> or <main>, such slots alone, else those below the path around the article's slots.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, texts_of, written

#: A class counts if it stands on so many pages, on this share of the host's pages with tokens, and has so many tokens.
LEAST_PAGES, LEAST_SHARE, LEAST_TOKENS = 3, 0.2, 2
#: Elements in more than so many others count as their parents.
DEEPEST = 200
#: What forms and notices hold is the text if it is so many times as long as all else that the template leaves.
OUTWEIGHS = 2
#: Templates are broadcast up to so many text tokens and hosts, else joined.
BROADCAST_ROWS = 50_000

# A comment, a declaration, a tag or text. Quotes count after an equals sign; no part of a match is tried in two ways, so a match
# takes time in proportion to what it reads. Where a tag does not end before the page does, SIMPLE ones end at the next angle.
_REST = r"|[^<]++|<"
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|</?([a-zA-Z][^\s/<>]*+)((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)>|</?[a-zA-Z][^<>]*+(?:>|\Z)?""" + _REST, re.DOTALL)
_SIMPLE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|</?([a-zA-Z][^\s/<>]*+)([^<>]*+)>|</?[a-zA-Z][^<>]*+" + _REST, re.DOTALL)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# What HTML's elements are.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe textarea title".split())
#: Parts that are left out whole; where one does not end before the next of its kind begins, its tag alone.
_PARTS = frozenset("svg select button object math audio video canvas".split())
_MARKED = frozenset("a label small span".split())
_ENDING = re.compile(rf"<(/?)({'|'.join(sorted(_RAW | _PARTS | _MARKED))})(?=[\s/>])[^<>]*+>?", re.IGNORECASE)
_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption".split())
_AWAY = frozenset("nav footer aside head menu".split())
_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar".split())
#: Parts that may also be around a whole page or its article.
_SOFT, _SOFT_ROLES = frozenset("form dialog fieldset".split()), frozenset("form alert alertdialog dialog".split())
_SOFT_NAMES = frozenset("form notice notices notification alert widget modal overlay popup paywall".split())
#: Names of readers' comments; and one that an article's own section may have, so that it counts where it repeats.
_COMMENTS, _TWOFOLD = frozenset("comment comments commentlist reply replies respond disqus".split()), frozenset(["discussion"])
_NAMES = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead topbar toolbar comment comments commentlist reply replies respond disqus discussion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended widget pagination pager form search skip paywall disclaimer".split())
#: Words that may stand beside those in a name, as in share-link; any other makes it another name, as in has-sidebar.
_BESIDE = frozenset("inline link links box bar list block item items button buttons site page top".split())


#: How far a block is from the text: it may be; only if nothing better is left; only if nothing at all is; never.
_TEXT, _MAYBE, _LAST, _NEVER = range(4)


class _Element:
    """An open or closed element: its name, path, and what speaks for leaving it out."""

    __slots__ = ("name", "path", "parent", "inside", "away", "named", "holds", "mark", "closed", "comment", "answers")

    def __init__(self, name: str, path: str, parent: _Element | None) -> None:
        self.name, self.path, self.parent = name, path, parent
        self.away = self.named = _TEXT
        self.mark, self.holds, self.closed, self.comment, self.answers = 0, False, False, False, False
        self.inside = parent is not None and (parent.inside or parent.name in ("article", "main") and not parent.comment)

    def level(self) -> tuple[int, tuple[int, ...]]:
        """How far it is from the text; and the marks that leave it out if they repeat on the host."""
        x, marks, level = self, [], _TEXT
        while x is not None:
            if x.away and not (x.holds and (x.away == _MAYBE or not x.closed)):
                level = max(level, x.away if x.closed else min(x.away, _MAYBE))
            if x.comment:
                level = max(level, _LAST)
            if x.mark:
                marks.append(x.mark)
            elif x.named and not x.holds:
                level = max(level, min(x.named, _LAST) if x.answers else x.named)
            x = x.parent
        return level, tuple(marks)


def _named(said: list[tuple[str, str]], more: tuple[str, ...] = ()) -> frozenset[str]:
    """The words of whole class names and ids that say that the element is no part of an article."""
    found: set[str] = set()
    for _, value in (x for x in said if x[0] != "role"):
        for whole in value.split():
            words = [w.lower() for w in _WORD.findall(whole)]
            if any(w in _NAMES or w in more for w in words) and all(w in _NAMES or w in more or w in _BESIDE for w in words):
                found.update(w for w in words if w not in _BESIDE)
    return frozenset(found)


def _answer(said: list[tuple[str, str]]) -> bool:
    """Whether a name begins as those of single comments do (comment-body, but not comments-open)."""
    return any((w := _WORD.match(whole)) and w[0].lower() in ("comment", "reply") for k, v in said if k != "role" for whole in v.split())


def blocks(html: str) -> tuple[list[tuple[str, str, tuple[int, ...], int]], list[tuple[str, int]], dict[int, int]]:
    """Of all_blocks those that may be text."""
    found, tags, marks = all_blocks(html)
    return [x[:4] for x in found if x[4] == _TEXT], tags, marks


def all_blocks(html: str) -> tuple[list[tuple[str, str, tuple[int, ...], int, int]], list[tuple[str, int]], dict[int, int]]:
    """The page's text blocks in order, (path, text, marks, place, level), its block-level tags, (path, place), and its marks' places.

    Left out are blocks inside elements that are no part of an article. A name alone never drops body, main, article or what
    holds one of them (readers' comments are no articles, whatever their element). Inside an article it makes a mark: such
    a block is to go only if one of its marks repeats on the host. A form around an article does not count, nor does a part
    without an end; forms and notices elsewhere are at a level of their own. A line break ends a block. Character
    references are decoded, white space is one space.
    """
    out: list[tuple[_Element, str, int]] = []
    tags: list[tuple[str, int]] = []
    stack: list[_Element] = [_Element("", "", None)]
    marks: dict[int, int] = {}
    text: list[str] = []
    below: list[str] = []  # open elements below the deepest that counts, and how often each
    deep: dict[str, int] = {}
    ends: dict[str, list[tuple[int, int, bool]]] = {}
    for m in _ENDING.finditer(html):
        ends.setdefault(m[2].lower(), []).append((m.start(), m.end(), bool(m[1])))
    passed = dict.fromkeys(ends, 0)

    def end_of(name: str, at: int) -> int | None:
        """Where the element that begins before at ends: behind its end tag, if that comes before another of its kind begins."""
        tags_, k = ends.get(name, ()), passed.get(name, 0)
        while k < len(tags_) and tags_[k][0] < at:
            k += 1
        passed[name] = k
        return tags_[k][1] if k < len(tags_) and tags_[k][2] else None

    def flush() -> None:
        if text:
            joined = _SPACE.sub(" ", unescape("".join(text))).strip()
            if joined:
                out.append((stack[-1], joined, len(out) + len(tags)))
            text.clear()

    at, end, token = 0, len(html), _TOKEN
    while at < end:
        m = token.match(html, at)
        if m[1] is None and token is _TOKEN and m[0][0] == "<" and m[0][1:2] not in ("", "!", "?"):  # a tag that does not end
            token = _SIMPLE
            m = token.match(html, at)
        at, whole, name = m.end(), m[0], m[1]
        if name is None:
            if whole[0] != "<" or whole == "<":
                text.append(whole)
            continue
        name = name.lower()
        if whole[1] == "/":
            if name in _INLINE or name in _VOID and name != "br":
                continue
            flush()
            if deep.get(name):
                while (last := below.pop()) != name:
                    deep[last] -= 1
                deep[name] -= 1
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    stack[k].closed = True
                    below.clear()
                    deep.clear()
                    del stack[k:]
                    tags.append((f"{stack[-1].path}/-{name}", len(out) + len(tags)))
                    break
            continue
        if name in _RAW or name in _PARTS:
            if whole[-2:] != "/>":
                behind = end_of(name, at)
                if behind is None and name in ("script", "style"):  # code without end: up to the next tag
                    behind = html.find("<", at)
                    behind = behind if behind >= 0 else end
                at = behind or at
            continue
        said = [(k.lower(), a or b or c) for k, a, b, c in _ATTRIBUTE.findall(m[2])] if m[2] else []
        if name in _INLINE and not said:
            continue
        roles = {v.lower() for k, v in said if k == "role"}
        away = _NEVER if name in _AWAY or roles & _ROLES else _MAYBE if name in _SOFT or roles & _SOFT_ROLES else _TEXT
        if name in _INLINE:
            if (away or _named(said)) and name in _MARKED:  # marked inline parts are left out to their end
                at = end_of(name, at) or at
            continue
        flush()
        if name in _VOID:
            continue
        if name in _LEAF or name in ("ul", "ol", "table", "div", "section", "article", "main", "footer", "nav", "aside", "form", "header"):
            for k in range(len(stack) - 1, 0, -1):  # a paragraph ends where a block begins; an item where the next begins
                if stack[k].name == "p" or stack[k].name == name and name in ("li", "dt", "dd", "td", "th"):
                    del stack[k:]
                    break
                if stack[k].name not in _LEAF:
                    break
        if name == "body":  # a head that was never closed ends here
            del stack[1 + (len(stack) > 1 and stack[1].name == "html") :]
        if len(stack) > DEEPEST:
            below.append(name)
            deep[name] = deep.get(name, 0) + 1
            continue
        path = stack[-1].path + "/" + name + "".join(sorted("." + _SPACE.sub(".", v.strip()) for k, v in said if k == "class"))
        own = _Element(name, path, stack[-1])
        whole_part = name in ("html", "body", "main", "article")
        own.away = _NEVER if name == "header" and not own.inside else away
        words = frozenset() if whole_part else _named(said, () if own.inside else ("header",))
        own.named = _TEXT if not words else _MAYBE if words <= _SOFT_NAMES else _NEVER
        if words and (own.inside or words <= _TWOFOLD):
            own.mark = _hash("mark", path, *sorted(v for k, v in said if k in ("class", "id")))
            marks.setdefault(own.mark, len(out) + len(tags))
        own.answers = bool(words & _COMMENTS)
        if name == "article":
            own.comment = bool(_named(said) & _COMMENTS) or _answer(said) or any(x.answers or x.comment for x in stack)
        if whole_part and not own.comment:
            for x in stack:
                x.holds = True
        stack.append(own)
        tags.append((path, len(out) + len(tags)))
    flush()
    known: dict[_Element, tuple[bool, tuple[int, ...]]] = {}
    for own, _, _ in out:
        if own not in known:
            known[own] = own.level()
    return [(own.path, joined, known[own][1], place, known[own][0]) for own, joined, place in out if known[own][0] < _NEVER], tags, marks


def _hash(*parts: str) -> int:
    h = xxhash.xxh64_intdigest("\x00".join(parts).encode("utf-8", "replace"))
    return h - (1 << 64) if h >> 63 else h


def _article(path: str) -> bool:
    return any(x.split(".")[0] in ("article", "main") for x in path.split("/"))


def occurrences(pages: DataFrame) -> DataFrame:
    """Rows (host, page, token, kind, path, n, chars, place): each page's distinct tokens, and how often they occur.

    kind is 0 for tags, 1 for text blocks, 2 for the page itself (one row for each page with any token), 3 for marks.
    """

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for host, page, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2))):
                found, tags, marks = all_blocks(html)
                own: dict[int, list] = {}
                for path, place in tags:
                    own.setdefault(_hash("tag", path), [host, page, 0, path, 0, 0, place])[4] += 1
                for path, text, _, place, level in found:
                    if level == _LAST:
                        continue
                    x = own.setdefault(_hash(path, text), [host, page, 1, path, 0, 0, place])
                    x[4] += 1
                    x[5] += len(text)
                for mark, place in marks.items():
                    own[mark] = [host, page, 3, "", 1, 0, place]
                rows += [(h, p, token, kind, path, n, chars, place) for token, (h, p, kind, path, n, chars, place) in own.items()]
                if own:
                    rows.append((host, page, 0, 2, "", 1, 0, 0))
            types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int32()]
            names = ["host", "page", "token", "kind", "path", "n", "chars", "place"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names)

        return each

    return map_rows(pages.select("host", "page", "html"), make, "host string, page long, token long, kind int, path string, n int, chars long, place int")


def _around(low: str, high: str) -> str:
    """SQL: the paths, from the empty one on, that enclose all of a set of paths with this least and this greatest one."""
    a, b = f"split({low}, '/')", f"split({high}, '/')"
    return f"transform(filter(sequence(1, least(size({a}), size({b}))), k -> slice({a}, 1, k) = slice({b}, 1, k)), k -> array_join(slice({a}, 1, k), '/'))"


def _in_article(path: str) -> str:
    return f"{path} RLIKE '/(article|main)([./]|$)'"


def class_tokens(found: DataFrame, tokens: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows (host, vector, pages, most, token, kind, path, rank) of all classes that hold: by support, order and nesting.

    A class of nothing but article text is a text that was published again, not a template.
    """
    by = ["host", "vector", "pages", "most"]
    sized = lambda df: df.groupBy(*by).agg(F.count("*").alias("size"), F.max(F.expr(f"kind = 0 OR NOT {_in_article('path')}")).alias("outside")).filter(f"size >= {LEAST_TOKENS} AND outside").select(*by)
    wide = tokens.filter("kind < 2 AND pages > 1").join(counts, "host").filter(f"pages >= {LEAST_SHARE} * all_pages AND pages >= least({LEAST_PAGES}, all_pages)").select(*by, "token", "kind", "path", "place")
    near = written(wide.join(sized(wide), by), "candidates")
    few = near.count() <= BROADCAST_ROWS
    small = lambda df: F.broadcast(df) if few else df
    # Order: on each page, a class' tokens by place; one that stands behind a token of greater mean place is out of order.
    seen = found.select("host", "page", "token", F.col("place").alias("at")).join(small(near.select("host", "token", "vector", "most", "place")), ["host", "token"])
    lines = seen.groupBy("host", "page", "vector", "most").agg(F.array_sort(F.collect_list(F.struct("at", "place", "token"))).alias("line"))  # no more than a page has tokens
    back = lines.select("host", F.explode(F.expr("filter(line, (x, i) -> i > 0 AND x.place < array_max(transform(slice(line, 1, i), y -> y.place)))")).alias("x")).select("host", F.col("x.token").alias("token")).distinct()
    straight = near.join(small(back), ["host", "token"], "left_anti")
    straight = written(straight.join(sized(straight), by), "ordered")
    # Nesting: some element around the class belongs to a class on as many pages or more; or nothing is around it.
    nests = straight.groupBy(*by).agg(F.min("path").alias("low"), F.max("path").alias("high")).select(*by, F.explode(F.expr(_around("low", "high"))).alias("path"))
    tags = straight.filter("kind = 0").groupBy("host", "path").agg(F.max("pages").alias("around"))
    top = nests.groupBy(*by).agg(F.max(F.length("path")).alias("deep")).filter("deep = 0").select(*by)
    nested = nests.join(tags, ["host", "path"]).filter("around >= pages").select(*by).unionByName(top).distinct()
    return straight.join(nested, by).withColumnRenamed("place", "rank")


def templates(pages: DataFrame) -> DataFrame:
    """Rows (host, fixed, marks): the classes' text blocks (token, class, mean place, whether it recurs), and the marks that repeat."""
    found = written(occurrences(pages), "occurrences")
    tokens = found.groupBy("host", "kind", "token", "path").agg(
        F.count("*").alias("pages"), F.bit_xor(F.xxhash64("page", "n")).alias("vector"), F.max("n").alias("most"), F.sum("chars").alias("chars"), F.avg("place").alias("place")
    )
    tokens = written(tokens, "tokens")
    counts = tokens.filter("kind = 2").select("host", F.col("pages").alias("all_pages"))
    held = written(class_tokens(found, tokens, counts).filter("kind = 1"), "classes")
    fixed = held.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("token", F.xxhash64("vector", "most").alias("class"), "rank", (F.col("most") > 1).alias("many")))).alias("fixed"))  # five times the text of a page's template at most
    marks = tokens.filter("kind = 3 AND pages > 1").join(counts, "host").filter(f"pages >= {LEAST_SHARE} * all_pages AND pages >= least({LEAST_PAGES}, all_pages)").groupBy("host").agg(F.collect_list("token").alias("marks"))  # each on a share of the pages
    return counts.select("host").join(fixed, "host", "left").join(marks, "host", "left").select("host", "fixed", "marks")


def slots_of(found: list[tuple[str, str]], fixed: list[dict]) -> list[tuple[str, str]]:
    """The blocks that the template leaves open: not those of its classes, each class in its order."""
    order, last, left = {x["token"]: x for x in fixed}, {}, []
    for path, text in found:
        x = order.get(_hash(path, text))
        if x and (x["many"] or x["rank"] > last.get(x["class"], -1.0)):
            last[x["class"]] = x["rank"]
        else:
            left.append((path, text))
    return left


def main_text(html: str, fixed: list[dict], main: None = None, marks: list[int] = ()) -> str:
    """The text of a page's article: the slots of its host's template, then those that element and class names leave."""
    gone = set(marks)
    every = [(path, text, level) for path, text, own, _, level in all_blocks(html)[0] if gone.isdisjoint(own)]
    upto = lambda most: [(path, text) for path, text, level in every if level <= most]
    found = upto(_TEXT)
    left = slots_of(found, fixed)
    inside = [x for x in left if _article(x[0])] or ([x for x in found if _article(x[0])] if fixed else [])
    if not inside:
        more = slots_of(upto(_MAYBE), fixed)
        long = lambda xs: sum(len(text) for _, text in xs)
        if long(more) > (1 + OUTWEIGHS) * long(left):
            left = more
    # A host whose pages are all the same has no template to tell from the text; a page of comments alone has nothing else.
    return "\n".join(text for _, text in inside or left or found or upto(_MAYBE) or upto(_LAST))


def extracted(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, text, n_chars) for every row of pages.

    Null and empty html give an empty text; a null or odd url counts as a host of its own name; rows with equal page_id are
    pages of their own. Extra columns are ignored.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]*)", 1)), F.lit(""))
    named = pages.select(F.col("page_id").cast("long").alias("page"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    known = written(templates(named.withColumn("page", F.monotonically_increasing_id())), "templates")  # a page is a row, whatever its id
    size = known.agg(F.count("*") + F.coalesce(F.sum(F.size(F.coalesce("fixed", F.array().cast(known.schema["fixed"].dataType)))), F.lit(0))).first()[0]
    both = named.join(F.broadcast(known) if size <= BROADCAST_ROWS else known, "host", "left")

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            text = [main_text(h, f or [], None, r or ()) for h, f, r in zip(texts_of(batch.column(2)), *(batch.column(k).to_pylist() for k in (3, 4)))]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(np.array([len(t) for t in text], np.int64))], ["page_id", "url", "text", "n_chars"])

        return each

    return map_rows(both.select("page", "url", "html", "fixed", "marks"), make, "page_id long, url string, text string, n_chars long")


def op2_html(spark, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
