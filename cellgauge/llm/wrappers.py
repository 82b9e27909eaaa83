"""Main text of web pages, by wrappers: one union-free regular expression for all pages of a host."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellgauge.llm.common import fresh, query, table
from cellgauge.llm.markup import FORM, HEADER, HEADING, MAIN, OUTSIDE, OUTSIDE_TAGS, TEXT, Node, Reader, Run
from cellgauge.plans import scale

GROUP = "()"
#: Elements of these names repeat whatever they hold; others without a class must hold alike things.
ROWS = HEADING | set("p li dt dd tr ul ol dl table tbody thead blockquote pre figure option caption figcaption".split())
#: Terms that are text rather than parts of a page; tables may be either.
TEXTUAL = (ROWS | {TEXT}) - {"table", "tbody", "tr"}
ALIKE = 0.5  # share of common children that makes two unnamed elements the same
MOST_KINDS = 64  # kinds of children of one element; beyond that they are told apart by their names only
DOMINANT = 0.5  # share of the text that makes an element the one to look into
LOOSE = 0.05  # share of the text beside it that forbids this
MINOR = 0.25  # marked articles with less than this share of the largest are asides
LINKED = 0.8  # share of link characters that makes a list a menu, outside marked articles
REPEATED = 3  # pages after which an unchanging text outside marked articles is part of the template
FAN = 64  # wrappers that one task aligns
HELD = 20_000  # different page structures a task holds before it aligns them
PARSED = 2_000  # wrappers a task keeps ready


class Part:
    """A term of a wrapper: an element, a repeated group of terms, or a text slot.

    ``least`` is 0 for optional terms, ``many`` says that it may repeat. Slots count
    their texts, characters and linked characters, and know the smallest and largest
    checksum: equal ones mean the same text on all pages.
    """

    __slots__ = ("key", "least", "many", "items", "stats")

    def __init__(self, key: str, least: int = 1, many: bool = False, items: list[Part] | None = None, stats: list[int] | None = None):
        self.key, self.least, self.many, self.items, self.stats = key, least, many, items or [], stats

    def shape(self) -> tuple:
        """Everything but the statistics."""
        return self.key, self.least, self.many, tuple(i.shape() for i in self.items)

    def slots(self) -> Iterator[Part]:
        if self.key == TEXT:
            yield self
        for item in self.items:
            yield from item.slots()

    def dump(self) -> list:
        return [self.key, self.least, int(self.many), [i.dump() for i in self.items], self.stats]

    @classmethod
    def load(cls, data: list) -> Part:
        key, least, many, items, stats = data
        return cls(key, least, bool(many), [cls.load(i) for i in items], stats)

    def __str__(self) -> str:
        inner = " ".join(map(str, self.items))
        body = inner if self.key == GROUP else self.key + (f"({inner})" if inner else "")
        mark = {(1, False): "", (0, False): "?", (1, True): "+", (0, True): "*"}[self.least, self.many]
        return f"({body}){mark}" if self.key == GROUP else body + mark


# --------------------------------------------------------------------------
# Alignment
# --------------------------------------------------------------------------


def singles(part: Part) -> list[Part]:
    """The terms that one step of a sequence can be: the members of a group, or the term itself."""
    return part.items if part.key == GROUP else [part]


def child_keys(part: Part | Node) -> set[str]:
    if isinstance(part, Node):
        return {c.key for c in part.children}
    return {s.key for i in part.items for s in singles(i)}


def nearness(one: set[str], other: set[str]) -> float:
    return len(one & other) / len(one | other) if one and other else 1.0


def named(key: str) -> bool:
    """Keys that say by themselves which part of a page it is: rows, texts, marked elements, those with a class."""
    return key in ROWS or key == TEXT or "." in key or key[-1] in (OUTSIDE, HEADER, FORM, MAIN, "*")


def same(one: Part, other: Part) -> bool:
    return one.key == other.key and (named(one.key) or nearness(child_keys(one), child_keys(other)) >= ALIKE)


def combine(one: Part, other: Part, many: bool = False) -> Part:
    """The least general term for both: their children aligned, differing texts become one slot."""
    if one.key == TEXT:
        a, b = one.stats, other.stats
        stats = [a[0] + b[0], a[1] + b[1], a[2] + b[2], min(a[3], b[3]), max(a[4], b[4])]
        return Part(TEXT, min(one.least, other.least), one.many or other.many or many, None, stats)
    return Part(one.key, min(one.least, other.least), one.many or other.many or many, align(one.items, other.items))


def coarse(key: str) -> str:
    """A key without classes, for elements that hold too many kinds."""
    kind = key[-1] if key[-1] in (OUTSIDE, HEADER, FORM, MAIN) else ""
    name = key.rstrip(OUTSIDE + HEADER + FORM + MAIN).split(".")[0]
    return key if key == TEXT else (name if name in ROWS else "any") + ".*" + kind


def coarsen(part: Part) -> Part:
    if part.key == GROUP:
        return Part(GROUP, part.least, part.many, [coarsen(i) for i in part.items])
    return Part(coarse(part.key), part.least, part.many, part.items, part.stats)


def classes(parts: Sequence[Part]) -> list[list[int]]:
    """For every part the numbers of the kinds it holds; parts of one kind are the same term."""
    by_key: dict[str, list[tuple[int, Part]]] = {}
    found, kinds = [], 0
    for part in parts:
        mine = []
        for single in singles(part):
            known = by_key.setdefault(single.key, [])
            number = next((n for n, k in known if named(single.key) or same(k, single)), None)
            if number is None:
                number, kinds = kinds, kinds + 1
                known.append((number, single))
            mine.append(number)
        found.append(mine)
    return found


def fold(parts: list[Part]) -> list[Part]:
    """Resolve what comes back in a sequence into repeated groups, so that every kind stands at one place.

    From the first occurrence of a kind to its last, and of every kind in between, the
    sequence is cut at each occurrence of its first term; the pieces are aligned with each
    other. Terms that some pieces lack are optional, the whole repeats.
    """
    if len(parts) < 2:
        return parts
    found = classes(parts)
    kinds = 1 + max(max(m) for m in found)
    if kinds > MOST_KINDS and any(coarse(s.key) != s.key for p in parts for s in singles(p)):
        return fold([coarsen(p) for p in parts])
    last = {kind: at for at, mine in enumerate(found) for kind in mine}
    out, at = [], 0
    while at < len(parts):
        end = look = at
        while look <= end:
            end = max(end, *(last[k] for k in found[look]))
            look += 1
        span, held = parts[at : end + 1], found[at : end + 1]
        at = end + 1
        if len(span) == 1:
            out.append(span[0])
        elif all(k == held[0] for k in held) and span[0].key != GROUP:
            whole = span[0]
            for part in span[1:]:
                whole = combine(whole, part, many=True)
            whole.least = max(p.least for p in span)
            out.append(whole)
        else:
            out.append(group(span, held))
    return out


def group(span: Sequence[Part], kinds: Sequence[list[int]]) -> Part:
    """One repeated group for a span of a sequence, its members in order of first appearance."""
    order: dict[int, int] = {}
    members: list[Part] = []
    pieces: list[list[int]] = []  # members in each piece, in sequence
    grouped = False
    for part, mine in zip(span, kinds):
        if part.key == GROUP:
            grouped = True
        for kind, single in zip(mine, singles(part)):
            if kind not in order:
                order[kind] = len(members)
                members.append(Part(single.key, single.least, single.many, single.items, single.stats))
                place = order[kind]
            else:
                place = order[kind]
                again = bool(pieces) and pieces[-1][-1:] == [place]  # next to itself: the member repeats
                members[place] = combine(members[place], single, many=again)
                if again:
                    continue
            if not pieces or (place == 0 and pieces[-1]):
                pieces.append([])
            pieces[-1].append(place)
    ordered = not grouped and all(a < b for piece in pieces for a, b in zip(piece, piece[1:]))
    for place, member in enumerate(members):
        if not ordered or not all(place in piece for piece in pieces):
            member.least = 0
    return Part(GROUP, max(p.least for p in span), True, members)


def overlap(one: Part, other: Part) -> bool:
    if one.key != GROUP and other.key != GROUP:
        return same(one, other)
    return any(same(a, b) for a in singles(one) for b in singles(other))


def optional(part: Part) -> Part:
    return Part(part.key, 0, part.many, part.items, part.stats)


def align(one: list[Part], other: list[Part]) -> list[Part]:
    """Align two sequences, each with every kind at one place; the result accepts what either accepts.

    Terms that match are combined, the others become optional, and kinds that now stand at
    two places are folded into a repeated group.
    """
    if len(one) == len(other) and all(a.key == b.key != GROUP and same(a, b) for a, b in zip(one, other)):
        return [combine(a, b) for a, b in zip(one, other)]
    n, m = len(one), len(other)
    match = [[overlap(a, b) for b in other] for a in one]
    best = [[0] * (m + 1) for _ in range(n + 1)]  # longest alignments of the rests
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if match[i][j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if match[i][j]:
            a, b = one[i], other[j]
            if a.key == b.key == GROUP and len(a.items) == len(b.items) and all(map(same, a.items, b.items)):
                out.append(Part(GROUP, min(a.least, b.least), True, list(map(combine, a.items, b.items))))
            elif a.key == GROUP or b.key == GROUP:
                joined = fold([a, b])
                for part in joined:
                    part.least = min(a.least, b.least)
                    part.many = True
                out += joined
            else:
                out.append(combine(a, b))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            out.append(optional(one[i]))
            i += 1
        else:
            out.append(optional(other[j]))
            j += 1
    out += [optional(p) for p in one[i:]] + [optional(p) for p in other[j:]]
    return fold(out)


def expression(node: Node | Run) -> Part:
    """A page, or a part of it, as a wrapper of its own."""
    if isinstance(node, Run):
        crc = zlib.crc32(node.text.encode("utf-8", "surrogatepass"))
        return Part(TEXT, stats=[1, len(node.text), node.linked, crc, crc])
    return Part(node.key, items=fold([expression(c) for c in node.children]))


def add_stats(to: Part, more: Part) -> None:
    """Add the statistics of a wrapper of the same shape."""
    for a, b in zip(to.slots(), more.slots()):
        s, t = a.stats, b.stats
        a.stats = [s[0] + t[0], s[1] + t[1], s[2] + t[2], min(s[3], t[3]), max(s[4], t[4])]


# --------------------------------------------------------------------------
# Which slots hold the main text
# --------------------------------------------------------------------------


def elements(part: Part) -> list[Part]:
    return [s for i in part.items for s in singles(i)]


def holds(part: Part, kind: str) -> bool:
    return any(e.key[-1] == kind or (e.key[-1] != OUTSIDE and holds(e, kind)) for e in elements(part))


def mass(part: Part, counted) -> int:
    """Characters that are no links, in the slots of a part that count."""
    return sum(s.stats[1] - s.stats[2] for s in part.slots() if counted(s))


def choose(wrapper: Part, pages: int) -> tuple[set[int], set[int]]:
    """Numbers of the slots with the main text, and of those to fall back on for a page without any.

    Elements marked as article hold it, with a first heading in the main part around them
    if they have none, or else elements marked as main. On hosts that mark neither, it is in
    the element that holds most of the text that changes from page to page, looked for
    from the top, but never in one term of a repetition; there, text that never changes and lists of links are the template's.
    Parts named as something else never count, headers and forms only where they hold the
    text or stand inside a marked article.
    """
    number = {id(s): i for i, s in enumerate(wrapper.slots())}
    changing = lambda s: s.stats[3] != s.stats[4]
    fixed = pages >= REPEATED and any(map(changing, wrapper.slots()))
    counted = changing if fixed else (lambda s: True)
    whole = mass(wrapper, lambda s: True)

    def dropped(part: Part, inside: bool) -> bool:
        kind = part.key[-1]
        if kind == OUTSIDE:
            return inside or not (rescue and part.key.rstrip(OUTSIDE).split(".")[0] not in OUTSIDE_TAGS and holds(part, MAIN))
        if kind == FORM:
            return not holds(part, MAIN) and (inside or 2 * mass(part, lambda s: True) < whole)
        return kind == HEADER and not inside and not holds(part, MAIN)

    def inner(part: Part, inside: bool) -> list[Part]:
        return [e for e in elements(part) if not dropped(e, inside)]

    def collect(part: Part, inside: bool, menu: bool = False) -> set[int]:
        """Slots below a part that are not dropped."""
        if part.key == TEXT:
            s = part.stats
            template = fixed and s[0] >= REPEATED and not changing(part)
            return set() if not inside and (template or menu and s[2] >= LINKED * s[1]) else {number[id(part)]}
        listed = menu or part.key.split(".")[0] in ("ul", "ol", "div", "table", "dl")
        return set().union(*(collect(e, inside, listed and part.key != "p") for e in inner(part, inside)))

    def marked(part: Part, names: tuple[str, ...]) -> list[Part]:
        found = []
        for e in inner(part, False):
            if e.key[-1] == MAIN and e.key.startswith(names):
                found.append(e)
            else:
                found += marked(e, names)
        return found

    def firsts(part: Part, without: Sequence[Part]) -> list[Part]:
        """The h1 elements below a part, but not below some others: titles stand before an article as well as in it."""
        below = [e for e in inner(part, True) if not any(e is w for w in without)]
        return [t for e in below for t in ([e] if e.key.split(".")[0] == "h1" else firsts(e, without))]

    every = lambda s: True
    rescue = False
    spare = collect(wrapper, False)
    for rescue in (False, True):  # a marked article inside a part named as something else counts if there is no other
        for names in (("article",), ("",)):
            found = marked(wrapper, names)
            if found:
                largest = max(mass(e, every) for e in found)
                chosen = [e for e in found if mass(e, every) >= MINOR * largest]
                titles = [] if any(firsts(e, ()) for e in chosen) else [t for m in marked(wrapper, ("",)) for t in firsts(m, found)]
                return set().union(*(collect(e, True) for e in [*chosen, *titles])), spare
    rescue = False
    at, titles = wrapper, set()
    while True:
        here = inner(at, False)
        plain = [e for e in here if e.key.split(".")[0] in TEXTUAL]
        once = [e for e in at.items if e.key != GROUP and not e.many and any(e is h for h in here)]
        boxes = [e for e in once if e.key.split(".")[0] not in TEXTUAL and child_keys(e) - {TEXT}]
        total = sum(mass(e, counted) for e in here)
        loose = sum(mass(e, counted) for e in plain if e.key.split(".")[0] not in HEADING)
        heaviest = max(boxes, key=lambda e: mass(e, counted), default=None)
        if heaviest is None or not total or mass(heaviest, counted) < DOMINANT * total or loose > LOOSE * total:
            return collect(at, False) | titles, spare
        titles |= set().union(*(collect(e, False) for e in here if e.key.split(".")[0] == "h1"))
        at = heaviest


# --------------------------------------------------------------------------
# Extraction
# --------------------------------------------------------------------------


class Level:
    """The terms below an element of a wrapper, by key, with their slot numbers."""

    __slots__ = ("terms",)

    def __init__(self, part: Part, slots: Iterator[int]):
        self.terms: dict[str, list[tuple[set[str], int | Level]]] = {}
        for item in part.items:
            for single in singles(item):
                below = next(slots) if single.key == TEXT else Level(single, slots)
                self.terms.setdefault(single.key, []).append((child_keys(single), below))

    def find(self, child: Node | Run) -> int | Level | None:
        """The term that takes a child: by key, among equal keys the one with the most alike children."""
        terms = self.terms.get(child.key) or self.terms.get(coarse(child.key))
        if not terms:
            return None
        if len(terms) == 1:
            return terms[0][1]
        keys = child_keys(child)
        return max(terms, key=lambda t: nearness(keys, t[0]))[1]


class Extractor:
    """A host's wrapper, ready to be matched with pages."""

    def __init__(self, stored: str):
        data = json.loads(stored)
        self.level = Level(Part.load(data["wrapper"]), iter(range(1 << 60)))
        self.main, self.spare = set(data["main"]), set(data["spare"])

    def runs(self, node: Node, level: Level) -> Iterator[tuple[int | None, str]]:
        for child in node.children:
            term = level.find(child)
            if isinstance(child, Run):
                yield term, child.text
            elif term is not None:
                yield from self.runs(child, term)

    def text(self, page: Node) -> str:
        """Texts in the main slots, in page order, joined by newlines; those of the spare slots if there are none."""
        found = list(self.runs(page, self.level))
        for slots in (self.main, self.spare):
            blocks = [text for slot, text in found if slot in slots]
            if blocks:
                return "\n".join(blocks)
        return ""


def host_of(url: Column) -> Column:
    """The host of an address in lower case; '' where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def align_all(wrappers: Sequence[Part]) -> Part:
    whole = wrappers[0]
    for other in wrappers[1:]:
        whole = combine(whole, other)
    return whole


PARTIAL = "host string, pages bigint, wrapper string"


def _partial(reader_batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wrappers of what one task reads, one a host: pages of one shape only add up, shapes are aligned."""
    reader = Reader()
    held: dict[str, dict[tuple, list]] = {}
    shapes = 0

    def settle() -> pa.RecordBatch:
        rows = []
        for host in sorted(held):
            ordered = sorted(held[host].items(), key=lambda kv: repr(kv[0]))
            whole = align_all([wrapper for _, (_, wrapper) in ordered])
            rows.append((host, sum(n for _, (n, _) in ordered), json.dumps(whole.dump())))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], ["host", "pages", "wrapper"])

    for batch in reader_batches:
        for host, page in zip(batch.column(0), batch.column(1)):
            wrapper = expression(reader.read(page.as_py()))
            mine = held.setdefault(host.as_py(), {})
            known = mine.get(shape := wrapper.shape())
            if known is None:
                mine[shape] = [1, wrapper]
                shapes += 1
            else:
                known[0] += 1
                add_stats(known[1], wrapper)
            if shapes >= HELD:
                yield settle()
                shapes = 0
    if held:
        yield settle()


def _aligned(rows: pd.DataFrame) -> tuple[Part, int]:
    ordered = rows.sort_values(["wrapper", "pages"])
    return align_all([Part.load(json.loads(w)) for w in ordered["wrapper"]]), int(rows["pages"].sum())


def _merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    wrapper, pages = _aligned(rows)
    return pd.DataFrame({"host": [key[0]], "pages": [pages], "wrapper": [json.dumps(wrapper.dump())]})


def _finish(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    wrapper, pages = _aligned(rows)
    main, spare = choose(wrapper, pages)
    stored = json.dumps({"wrapper": wrapper.dump(), "main": sorted(main), "spare": sorted(spare)})
    return pd.DataFrame({"host": [key[0]], "pages": [pages], "pattern": [str(wrapper)], "wrapper": [stored]})


def infer(pages: DataFrame, url_column: str = "url", html_column: str = "html", *, fan: int = FAN) -> DataFrame:
    """One wrapper a host from all its pages: host, pages, pattern (to read) and wrapper (to match), settled.

    Each task aligns the pages it reads, host by host; what is left are a few wrappers a
    host and task, which are aligned ``fan`` at a time, in as many levels as the host with
    the most of them needs. So no task ever sees the pages of a hot host, and no page moves.
    Addresses without a host share one wrapper; null pages are empty. An empty table gives
    no wrapper.
    """
    read = pages.select(host_of(F.col(url_column)).alias("host"), F.col(html_column).cast("string").alias("html"))
    partial = scale.settle(read.mapInArrow(_partial, PARTIAL))
    most = partial.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    while most > fan:
        ways = -(-most // fan)
        salt = F.pmod(F.xxhash64("wrapper", "pages", F.monotonically_increasing_id()), F.lit(ways))
        salted = scale.settle(partial.withColumn("salt", salt))
        partial = scale.settle(salted.groupBy("host", "salt").applyInPandas(_merge, PARTIAL))
        most = min(ways, partial.groupBy("host").count().agg(F.max("count")).first()[0])
    return scale.settle(partial.groupBy("host").applyInPandas(_finish, "host string, pages bigint, pattern string, wrapper string"))


def extract(
    pages: DataFrame, wrappers: DataFrame, url_column: str = "url", html_column: str = "html", out: str = "main_text", *,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add the main text of every page by its host's wrapper; ``keep`` names the other columns (default: all but the page).

    White space inside a block is one space, blocks are joined by one newline, character
    references are decoded. Null and empty pages have the text ''. A page whose host has no
    wrapper keeps all its text that no part of it marks as something else. A clashing
    column is replaced. Wrappers go to the pages: by broadcast while they are small, beyond
    that by broadcast for hot hosts and by a join for the others.
    """
    kept = [c for c in (pages.columns if keep is None else keep) if c.lower() != out.lower() and (keep is not None or c != html_column)]
    host, page, count, stored = fresh(pages, "page_host", "page_html", "page_count", "page_wrapper")
    rows = pages.select(*kept, F.col(html_column).cast("string").alias(page), host_of(F.col(url_column)).alias(host))
    few = wrappers.select(F.col("host").alias(host), F.col("pages").alias(count), F.col("wrapper").alias(stored))
    size = few.agg(F.count(F.lit(1)), F.sum(F.octet_length(stored))).first()
    each = max(64, -(-(size[1] or 0) // max(1, size[0])))
    joined = scale.attach(rows, few, [host], how="left", weight=count, row_bytes=each, rows=size[0])
    schema = T.StructType([*[pages.schema[c] for c in kept], T.StructField(out, T.StringType())])

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, ready = Reader(), {}
        for batch in batches:
            texts = []
            for html, wrapper in zip(batch.column(len(kept)), batch.column(len(kept) + 1)):
                tree, wrapper = reader.read(html.as_py()), wrapper.as_py()
                if wrapper not in ready:
                    if len(ready) >= PARSED:
                        ready.clear()
                    ready[wrapper] = Extractor(wrapper) if wrapper is not None else None
                found = ready[wrapper] or own_wrapper(tree)
                texts.append(found.text(tree))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(texts, pa.string())], [*kept, out])

    return joined.select(*kept, page, stored).mapInArrow(extracted, schema)


def own_wrapper(page: Node) -> Extractor:
    """The wrapper of a single page."""
    wrapper = expression(page)
    main, spare = choose(wrapper, 1)
    return Extractor(json.dumps({"wrapper": wrapper.dump(), "main": sorted(main), "spare": sorted(spare)}))


def main_text(pages: DataFrame, url_column: str = "url", html_column: str = "html", out: str = "main_text", *, keep: Sequence[str] | None = None) -> DataFrame:
    """Infer the wrappers of all hosts from all pages, then extract."""
    return extract(pages, infer(pages, url_column, html_column), url_column, html_column, out, keep=keep)


@query("op11_html_extraction")
def op11_html_extraction(spark, sf):
    done = main_text(table(spark, sf, "pages").select("page_id", "url", "html"), out="text", keep=["page_id", "url"])
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
