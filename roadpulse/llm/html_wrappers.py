"""Main text of pages by union-free wrappers of their hosts.

A page is a stream of block tags and text slots. Same-host streams are aligned one after the other: equal tags meet, what only
one side has becomes optional, what follows itself becomes a repeated group, and differing texts become slots. The result is a
regular expression without unions for the host's pages. Together with the slots' texts over all pages (how much, how much of it
links, whether it ever changes) it tells which part of the template holds the article; that part is read from every page.

Only class names and ids that recur over a host's pages tell its elements apart (see `known_names`), so a wrapper and the paths of
a host do not grow with its pages. Tasks reduce their pages to distinct streams and sums first, wrappers are merged in rounds
of bounded groups, and the article is picked by aggregates over (host, path).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadpulse.llm.common import free_name, portions, tasks
from roadpulse.llm.markup import BLOCKS, CONTROLS, HEADINGS, Node, blocks, own_text, parse, walk
from roadpulse.session import cut_lineage

#: Wrappers that are merged in one task.
GROUP = 200
#: Bytes of decisions up to which every task gets all of them.
SMALL = 32 << 20

#: Different pages of a host that have to share a text before it counts as the site's and not the page's.
SHARED = 3

#: A name is part of the signature if one in so many pages of its host has it.
RARE = 50

#: Fixed names of what is no article: elements, roles, and words of class names.
ASIDE_TAGS = frozenset("nav footer aside form fieldset dialog menu".split()) | CONTROLS
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
ASIDE_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar sidebars nav "
    "navbar navigation menu breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices notification alert "
    "disclaimer newsletter subscribe subscription signup popup modal overlay social share sharing related recommended recommendations "
    "comment comments commentlist disqus discussion replies reply respond login search pagination pager toolbar widget widgets skip "
    "outbrain taboola paywall teaser teasers".split()
)
KEEPS = frozenset("with has no without is not".split())
ARTICLE_WORDS = frozenset("article articlebody post entry story content main maincontent body text prose".split())


def words_of(name: str) -> list[str]:
    return [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if w]


@lru_cache(maxsize=20_000)
def named_aside(name: str) -> bool:
    """Whether a class name or id says that its element is no article."""
    found = words_of(name)
    if not found or KEEPS.intersection(found) or len(found) > 3:
        return False
    return found[0] in ASIDE_WORDS or found[-1] in ASIDE_WORDS or "".join(found) in ASIDE_WORDS


@lru_cache(maxsize=20_000)
def rank(tag: str, names: tuple[str, ...], role: str) -> int:
    """How clearly an element names itself the article: 3 clearly, 0 not at all."""
    if tag == "article" or role in ("article", "articlebody"):
        return 3
    if tag == "main" or role in ("main", "mainentity"):
        return 2
    if tag in ("div", "section", "td"):
        for name in names:
            found = words_of(name)
            if found and len(found) <= 3 and (found[-1] in ARTICLE_WORDS or "".join(found) in ARTICLE_WORDS) and not named_aside(name):
                return 1
    return 0


def holders(root: Node) -> set[int]:
    """Ids of the nodes that hold an element that names itself the article: they are not aside, whatever they are called."""
    found: set[int] = set()
    work: list[tuple[Node, bool]] = [(root, False)]
    while work:
        node, seen = work.pop()
        own = [c for c in node.children if isinstance(c, Node)]
        if not seen:
            work.append((node, True))
            work += [(c, False) for c in own]
        elif any(id(c) in found or (rank(c.tag, c.names, c.role) >= 2 and not any(map(named_aside, c.names))) for c in own):
            found.add(id(node))
    return found


def is_aside(node: Node, kept: set[int], inside: bool) -> bool:
    """Whether a node is left out. `inside` the article a header may hold its headings."""
    if node.hidden or node.tag in ("head", "title"):
        return True
    named = node.tag not in HEADINGS and any(map(named_aside, node.names))
    if node.tag in ("html", "body", "main", "#root") or (not named and rank(node.tag, node.names, node.role) == 3):
        return False
    if id(node) in kept and (not named or node.tag != "article"):
        return False
    if node.tag in ASIDE_TAGS or node.role in ASIDE_ROLES:
        return True
    if node.tag == "header" and not inside:
        return True
    if not inside and any(words_of(n)[-1:] == ["header"] for n in node.names):
        return True
    return named


def unheaded(header: Node) -> set[int]:
    """Ids of the blocks of an article's header that are no headings and hold none."""
    blocks_of = [n for n in walk(header) if n is not header and n.tag in BLOCKS]
    return {id(n) for n in blocks_of if not any(x.tag in HEADINGS for x in walk(n))}


# --- streams and wrappers -------------------------------------------------------------------------------------------------

# An item of a wrapper is [name, optional, repeated, items]. Names are "#" for a text slot, "()" for a group, else a tag.


def stream(node: Node) -> list:
    """A page's stream as nested items, folded."""
    made: dict[int, list] = {}
    for n in reversed(walk(node)):
        items: list = []
        for c in n.children:
            if isinstance(c, str):
                if not c.isspace() and c and not (items and items[-1][0] == "#"):
                    items.append(["#", False, False, []])
            elif c.tag in BLOCKS:
                items.append([c.signature, False, False, made.pop(id(c))])
            else:
                inner = made.pop(id(c), [])
                if inner and not (items and items[-1][0] == "#" and inner == [["#", False, False, []]]):
                    items += inner
        made[id(n)] = fold(items)
    return made[id(node)]


def trimmed(signature: str, known: set[str]) -> str:
    """A signature without the names that are not known."""
    tag, *names = signature.split(".")
    return ".".join([tag, *[n for n in names if n in known]])


def trim(items: list, known: set[str]) -> list:
    """A stream without the names that are not known, folded again."""
    out = []
    for name, optional, repeated, inner in items:
        inner = trim(inner, known)
        if name == "()" and len(inner) == 1:
            one = inner[0]
            out.append([one[0], optional or one[1], repeated or one[2], one[3]])
        else:
            out.append([trimmed(name, known), optional, repeated, inner])
    return fold(out)


def _names(item: list) -> object:
    return item[0] if item[0] != "()" else ("()", tuple(_names(i) for i in item[3]))


def fold(items: list) -> list:
    """Runs of equal items, or of equal groups of up to four, become one repeated item."""
    for width in (1, 2, 3, 4):
        out: list = []
        k = 0
        while k < len(items):
            run = items[k : k + width]
            n = 1
            names = [_names(i) for i in run]
            while len(run) == width and (width == 1 or len(set(map(str, names))) > 1) and [_names(i) for i in items[k + n * width : k + (n + 1) * width]] == names:
                following = items[k + n * width : k + (n + 1) * width]
                run = [both(a, b) for a, b in zip(run, following, strict=True)]
                n += 1
            if n == 1:
                out.append(items[k])
                k += 1
            elif width == 1:
                out.append([run[0][0], run[0][1], run[0][0] != "#", run[0][3]])
                k += n
            else:
                out.append(["()", False, True, run])
                k += n * width
        items = out
    return items


def both(a: list, b: list) -> list:
    """One item for two of the same name."""
    return [a[0], a[1] or b[1], a[2] or b[2], align(a[3], b[3])]


def align(a: list, b: list) -> list:
    """Items that match both lists: the longest common part meets, the rest is optional, and runs are folded again."""
    if a == b:
        return a
    names_a, names_b = [_names(i) for i in a], [_names(i) for i in b]
    longest = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            longest[i][j] = longest[i + 1][j + 1] + 1 if names_a[i] == names_b[j] else max(longest[i + 1][j], longest[i][j + 1])
    out: list = []
    i = j = 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and names_a[i] == names_b[j]:
            out.append(both(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == len(b) or (i < len(a) and longest[i + 1][j] >= longest[i][j + 1]):
            out.append([a[i][0], True, a[i][2], a[i][3]])
            i += 1
        else:
            out.append([b[j][0], True, b[j][2], b[j][3]])
            j += 1
    return fold(out)


def expression(items: list) -> str:
    """A wrapper as a regular expression: `<tag>…</tag>`, `#` for text, `( )?` optional, `( )+` repeated, `( )*` both."""
    out = []
    for name, optional, repeated, inner in items:
        body = "#" if name == "#" else expression(inner) if name == "()" else f"<{name}>{expression(inner)}</{name.split('.')[0]}>"
        mark = "*" if optional and repeated else "?" if optional else "+" if repeated else ""
        out.append(f"({body}){mark}" if mark or name == "()" else body)
    return "".join(out)


class Level:
    """The items of a wrapper below one tag, groups dissolved, and the places that a page's tags and texts have among them."""

    def __init__(self, items: list) -> None:
        self.names: list[str] = []
        self.segments: list[str] = []
        self.repeated: list[bool] = []
        self.items: list[list] = []
        self.groups: list[tuple[int, int]] = []
        self.needed = [0]
        """How many of the items before each are not optional."""
        self._add(items, False)
        self.places: dict[str, list[int]] = {}
        for k, name in enumerate(self.names):
            self.places.setdefault(name, []).append(k)
            same = len(self.places[name])
            self.segments.append(name if same == 1 else f"{name}~{same}")
        self.inner: dict[int, Level] = {}
        self.met: dict[tuple[str, ...], list[int | None]] = {}

    def _add(self, items: list, optional: bool) -> None:
        for name, may, again, inner in items:
            if name == "()":
                start = len(self.names)
                self._add(inner, optional or may)
                if again:
                    self.groups.append((start, len(self.names)))
            else:
                self.names.append(name)
                self.repeated.append(again)
                self.items.append(inner)
                self.needed.append(self.needed[-1] + (not (optional or may)))

    def below(self, k: int) -> Level:
        if k not in self.inner:
            self.inner[k] = Level(self.items[k])
        return self.inner[k]

    def _step(self, i: int, j: int) -> int | None:
        """Items that are not optional and are left out between two places; None if j cannot follow i."""
        if j > i:
            return self.needed[j] - self.needed[i + 1]
        if j == i and self.repeated[i]:
            return 0
        turns = [self.needed[e] - self.needed[i + 1] + self.needed[j] - self.needed[s] for s, e in self.groups if s <= j and i < e]
        return min(turns) if turns else None

    def match(self, names: tuple[str, ...]) -> list[int | None]:
        """The place of each name with the fewest items left out; None for what the wrapper does not have there."""
        if names in self.met:
            return self.met[names]
        states: dict[int, int] = {-1: 0}
        back: list[dict[int, int] | None] = []
        for name in names:
            new: dict[int, int] = {}
            came: dict[int, int] = {}
            for j in self.places.get(name, ()):
                for i, cost in states.items():
                    step = self._step(i, j)
                    if step is not None and (j not in new or cost + step < new[j]):
                        new[j], came[j] = cost + step, i
            back.append(came or None)
            states = new or states
        last = min(states, key=lambda i: (states[i] + self.needed[-1] - self.needed[i + 1], i))
        out: list[int | None] = []
        for came in reversed(back):
            out.append(last if came else None)
            last = came[last] if came else last
        out.reverse()
        if len(self.met) > 2_000:
            self.met.clear()
        self.met[names] = out
        return out


@lru_cache(maxsize=500)
def read_wrapper(wrapper: str) -> Level:
    return Level(json.loads(wrapper))


def tokens(node: Node, held: set[str] | None, kept: set[int], inside: bool) -> list[tuple[str, object, bool]]:
    """Tags and text slots of a block, as in its stream: name, node or the `(holder, index)` of its strings, whether aside."""
    out: list[tuple[str, object, bool]] = []
    work: list[tuple[Node, int, bool]] = [(node, 0, False)]
    while work:
        n, k, aside = work.pop()
        while k < len(n.children):
            c = n.children[k]
            k += 1
            if isinstance(c, str):
                if c and not c.isspace():
                    if not (out and out[-1][0] == "#"):
                        out.append(("#", [], False))
                    if not aside:
                        out[-1][1].append((n, k - 1))
            elif c.tag in BLOCKS:
                signature = c.signature if held is None else trimmed(c.signature, held)
                out.append((signature, c, aside or is_aside(c, kept, inside)))
            else:
                work.append((n, k, aside))
                n, k, aside = c, 0, aside or is_aside(c, kept, inside)
    return out


def placed(root: Node, level: Level | None, held: set[str] | None) -> Iterator[tuple[str, Node, list[tuple[str, list]]]]:
    """Place of every block outside what is aside, and the places and strings of its text slots.

    A place is a path of tags; `~2` is the second item of that name in the wrapper at its level, `~0` is none of them.
    """
    kept = holders(root)
    work: list[tuple[str, Node, Level | None, bool]] = [("", root, level, False)]
    while work:
        path, node, level, inside = work.pop()
        found = tokens(node, held, kept, inside)
        spots = [None] * len(found) if level is None else level.match(tuple(t[0] for t in found))
        slots, deeper = [], []
        for (name, what, aside), k in zip(found, spots, strict=True):
            place = f"{path}/{name if level is None else f'{name}~0' if k is None else level.segments[k]}"
            if name == "#":
                slots.append((place, what))
            elif not aside:
                below = None if level is None else NOTHING if k is None else level.below(k)
                deeper.append((place, what, below, inside or rank(what.tag, what.names, what.role) >= 2))
        yield path, node, slots
        work += reversed(deeper)


NOTHING = Level([])


# --- over all pages ---------------------------------------------------------------------------------------------------------


def _spans(root: Node) -> Iterator[tuple[str, Node, bool]]:
    """Path and node of every block outside what is aside, and whether it names itself the article."""
    kept = holders(root)
    work: list[tuple[str, Node, bool]] = [("", root, False)]
    while work:
        path, node, inside = work.pop()
        for c in node.children:
            if isinstance(c, Node) and not is_aside(c, kept, inside):
                here = f"{path}/{c.signature}" if c.tag in BLOCKS else path
                if c.tag in BLOCKS:
                    yield here, c, rank(c.tag, c.names, c.role)
                work.append((here, c, inside or rank(c.tag, c.names, c.role) >= 2))


def host_of(url: Column) -> Column:
    """Host of a URL in small letters; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _reduced(pages: DataFrame) -> DataFrame:
    """`(host, kind, name, rows, chars, linked, least, most, seen)`: distinct streams (kind 0), how many
    pages have a name or are there at all (kind 2, name empty), and in `_sums` places (kind 1). Sums are own text, text in links, the least and greatest
    hash of the text, and up to `SHARED` different pages. Pages with the same texts are one page, so that copies do not make their
    article the site's."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int, str], list] = {}
        for whole in batches:
            for batch in portions(whole, 1):
                for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    root = parse(source)
                    name = json.dumps(stream(root), separators=(",", ":"))
                    held.setdefault((host, 0, name), [0, 0, 0, 0, 0, set()])
                    page = xxhash.xxh3_64_intdigest("\n".join(own_text(node) for _, node, _ in _spans(root))) >> 1
                    for name in {"", *[x for n in walk(root) if n.tag in BLOCKS for x in n.names]}:
                        sums = held.setdefault((host, 2, name), [0, 0, 0, 0, 0, set()])
                        sums[0] += 1
                        if len(sums[5]) < SHARED:
                            sums[5].add(page)
                if len(held) > 50_000:
                    yield _rows(held)
                    held = {}
        yield _rows(held)

    return _summed(pages.mapInArrow(over, REDUCED))


REDUCED = "host string, kind int, name string, rows long, chars long, linked long, least long, most long, seen array<long>"


def _summed(reduced: DataFrame) -> DataFrame:
    return reduced.groupBy("host", "kind", "name").agg(
        *[F.sum(c).alias(c) for c in ("rows", "chars", "linked")],
        F.min("least").alias("least"),
        F.max("most").alias("most"),
        # Enough to tell fewer from SHARED.
        F.slice(F.array_distinct(F.flatten(F.collect_set("seen"))), 1, SHARED).alias("seen"),
    )


def _rows(held: dict) -> pa.RecordBatch:
    keys, sums = list(held), list(held.values())
    arrays = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.string())]
    arrays += [pa.array([s[i] for s in sums], pa.int64()) for i in range(5)]
    arrays.append(pa.array([sorted(s[5]) for s in sums], pa.list_(pa.int64())))
    return pa.RecordBatch.from_arrays(arrays, names=["host", "kind", "name", "rows", "chars", "linked", "least", "most", "seen"])


def known_names(reduced: DataFrame) -> DataFrame:
    """`(host, known)`: class names and ids on `SHARED` different pages of the host and on one in `RARE` of its pages, so that a
    host has at most `RARE` times as many as a page. Names of one page, such as those of headings, tell pages apart and not their
    parts. A host with fewer different pages keeps all names."""
    counted = reduced.where(F.col("kind") == 2).select("host", "name", "rows", F.size("seen").alias("pages"))
    hosts = counted.where(F.col("name") == "").select("host", F.col("rows").alias("all_rows"), F.col("pages").alias("all_pages"))
    shared = (F.col("pages") >= SHARED) & (F.col("rows") * RARE >= F.col("all_rows"))
    kept = counted.where(F.col("name") != "").join(hosts, "host").where(shared | (F.col("all_pages") < SHARED))
    return kept.groupBy("host").agg(F.sort_array(F.collect_list("name")).alias("known"))


def _trimmed(reduced: DataFrame) -> DataFrame:
    """Streams of `reduced` with the known names alone."""
    known = cut_lineage(known_names(reduced))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = zip(batch.column(2).to_pylist(), batch.column(9).to_pylist(), strict=True)
            made = [json.dumps(trim(json.loads(name), set(names or [])), separators=(",", ":")) for name, names in found]
            columns = [*batch.columns[:2], pa.array(made, pa.string()), *batch.columns[3:9]]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:9])

    size = known.select(F.sum(F.length(F.array_join("known", " ")) + 64)).first()[0] or 0
    rows = reduced.where(F.col("kind") == 0).join(F.broadcast(known) if size <= SMALL else known, "host", "left")
    order = ["host", "kind", "name", "rows", "chars", "linked", "least", "most", "seen", "known"]
    return _summed(rows.select(*order).mapInArrow(over, REDUCED))


def infer_wrappers(streams: DataFrame) -> DataFrame:
    """`(host, wrapper)` from distinct `(host, wrapper)` streams: each round aligns groups of at most about `GROUP`, until
    every host has one."""
    while True:
        counted = streams.groupBy("host").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"), F.count("*").alias("n"))
        counted = cut_lineage(counted)
        if not counted.where(F.col("n") > 1).head(1):
            return streams.select("host", "wrapper")
        placed = streams.join(counted, "host").withColumn("part", F.pmod(F.hash("wrapper"), F.col("groups")))

        def merge(group: pd.DataFrame) -> pd.DataFrame:
            made = None
            for wrapper in sorted(group["wrapper"], key=lambda w: (len(w), w)):
                items = json.loads(wrapper)
                made = items if made is None else align(made, items)
            return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [json.dumps(made, separators=(",", ":"))]})

        size = tasks(streams.sparkSession)
        merged = placed.select("host", "part", "wrapper").repartition(size, "host", "part").groupBy("host", "part")
        streams = cut_lineage(merged.applyInPandas(merge, "host string, wrapper string").distinct())


def decide(paths_of: DataFrame) -> DataFrame:
    """`(host, main, template)` from `(host, path, clear, chars, linked, fixed)`, one row per place: places of the article, and of
    text slots that never change. Hosts without text may be missing."""
    weight = F.col("chars") - F.col("linked")
    changing = F.when(F.col("fixed"), 0).otherwise(weight)
    parts = F.split("path", "/")
    upward = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    up = paths_of.withColumn("above", F.explode(upward))
    below = up.groupBy("host", F.col("above")).agg(F.sum(weight).alias("weight"), F.sum(changing).alias("changing"))
    below = cut_lineage(below.withColumnRenamed("above", "path"))
    totals = cut_lineage(paths_of.groupBy("host").agg(F.sum("chars").alias("total"), F.sum(changing).alias("prose")))
    # The outermost paths that name themselves the article, by how clearly they do.
    named = paths_of.where(F.col("clear") > 0).select("host", "path", "clear")
    above = up.where((F.col("clear") > 0) & (F.col("above") != F.col("path"))).select("host", "path", "clear", "above")
    inner = above.join(named.withColumnRenamed("path", "above"), ["host", "above", "clear"], "left_semi")
    outer = named.join(inner, ["host", "path", "clear"], "left_anti").join(below, ["host", "path"])
    told = outer.groupBy("host", "clear").agg(F.sort_array(F.collect_list("path")).alias("named"), F.sum("weight").alias("weight"))
    told = told.join(totals, "host").where(F.col("weight") >= 0.25 * F.col("total"))
    told = told.groupBy("host").agg(F.max_by("named", "clear").alias("named"))
    # Without them the deepest path that holds most of the changing prose; such paths lie one in the other.
    heavy = below.join(totals, "host").where((F.col("prose") > 0) & (F.col("changing") >= 0.6 * F.col("prose")))
    heavy = heavy.where(~F.col("path").rlike(r"/(#|(p|h[1-6])([.~/]|$))"))
    best = heavy.groupBy("host").agg(F.max_by("path", F.size(F.split("path", "/"))).alias("best"))
    fixed = paths_of.where("fixed").groupBy("host").agg(F.sort_array(F.collect_list("path")).alias("template"))
    made = totals.join(told, "host", "left").join(best, "host", "left").join(fixed, "host", "left")
    none = F.array().cast("array<string>")
    found = F.when(F.col("best").isNotNull(), F.array("best")).otherwise(none)
    return made.select(
        "host", F.coalesce("named", found).alias("main"), F.when(F.col("named").isNull(), F.coalesce("template", none)).otherwise(none).alias("template")
    )


def decisions(reduced: DataFrame) -> DataFrame:
    """`(host, wrapper, known)`, one row per host."""
    streams = _trimmed(reduced).select("host", F.col("name").alias("wrapper"))
    return infer_wrappers(cut_lineage(streams)).join(known_names(reduced), "host", "left")


def _told(pages: DataFrame, hosts: DataFrame, host: str, *columns: str) -> DataFrame:
    """`pages` with the columns of their hosts."""
    letters = [F.coalesce(F.length(F.array_join(c, " ") if kind.startswith("array") else F.col(c)), F.lit(0)) for c, kind in hosts.dtypes]
    size = hosts.select(F.sum(sum(letters, F.lit(64)))).first()[0] or 0
    return pages.join(F.broadcast(hosts) if size <= SMALL else hosts, host, "left").select(*columns)


def _sums(pages: DataFrame) -> DataFrame:
    """Sums of places over `(host, html, wrapper, known)`, in the form of `_reduced`."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int, str], list] = {}
        for whole in batches:
            for batch in portions(whole, 1):
                for host, source, wrapper, known in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    found: list[tuple[str, int, str]] = []
                    for place, node, slots in placed(parse(source), read_wrapper(wrapper), set(known or [])):
                        texts = [" ".join("".join(n.children[k] for n, k in strings).split()) for _, strings in slots]
                        found.append((f"{rank(node.tag, node.names, node.role)}{place}", 0 if slots else node.linked, ""))
                        # Text in links is counted once per block.
                        found += [(f"0{s[0]}", 0 if k else node.linked, t) for k, (s, t) in enumerate(zip(slots, texts, strict=True))]
                    page = xxhash.xxh3_64_intdigest("\n".join(f[2] for f in found)) >> 1
                    for name, linked, text in found:
                        h = xxhash.xxh3_64_intdigest(text) >> 1
                        sums = held.setdefault((host, 1, name), [0, 0, 0, h, h, set()])
                        sums[1] += len(text)
                        sums[2] += linked
                        sums[3], sums[4] = min(sums[3], h), max(sums[4], h)
                        if len(sums[5]) < SHARED:
                            sums[5].add(page)
                if len(held) > 50_000:
                    yield _rows(held)
                    held = {}
        yield _rows(held)

    return _summed(pages.mapInArrow(over, REDUCED))


def articles(sums: DataFrame) -> DataFrame:
    """`(host, main, template)` from the sums of the places, see `decide`."""
    sums = sums.select("*", F.substring("name", 1, 1).cast("int").alias("clear"), F.expr("substring(name, 2)").alias("path")).where("path != ''")
    sums = sums.groupBy("host", "path").agg(
        F.max("clear").alias("clear"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"),
        F.min("least").alias("least"), F.max("most").alias("most"), F.size(F.array_distinct(F.flatten(F.collect_set("seen")))).alias("pages"),
    )
    fixed = (F.col("pages") >= SHARED) & (F.col("least") == F.col("most")) & (F.col("chars") > 0)
    return decide(cut_lineage(sums.select("host", "path", "clear", "chars", "linked", fixed.alias("fixed"))))


def main_text(source: str | None, main: list[str], template: list[str], wrapper: str | None = None, known: list[str] | None = None) -> str:
    """The article's blocks, joined by an empty line: the places `main` of the wrapper without its text slots `template`. `known`
    are the names that places hold, all if None; without a wrapper, places are paths."""
    root = parse(source)
    kept = holders(root)
    wanted, dropped = set(main), set(template)
    chosen: list[Node] = []
    fixed: list[tuple[Node, int]] = []
    within: list[str] = []
    for path, node, slots in placed(root, read_wrapper(wrapper) if wrapper else None, None if known is None else set(known)):
        if path in wanted and not any(path.startswith(f"{w}/") for w in within):
            chosen.append(node)
            within.append(path)
        fixed += [x for place, strings in slots if place in dropped for x in strings]
    if chosen:
        for holder, k in fixed:
            holder.children[k] = " "
    left: set[int] = set()
    if not chosen:
        # A page unlike the others of its host: by its own words.
        named = [(rank(n.tag, n.names, n.role), n) for n in walk(root)]
        best = max((r for r, _ in named), default=0)
        found = [n for r, n in named if r == best and best >= 2]
        inner = {id(x) for n in found for x in walk(n)[1:]}
        chosen = [n for n in found if id(n) not in inner] or [root]
    inside = {id(x) for n in chosen for x in walk(n)} if chosen != [root] else set()
    for n in chosen:
        for x in walk(n):
            if x.tag == "header" and id(x) in inside:
                left |= unheaded(x)

    def skip(node: Node) -> bool:
        return id(node) in left or is_aside(node, kept, id(node) in inside)

    return "\n\n".join(b for top in chosen for b in blocks(top, lambda n, top=top: n is not top and skip(n)))


def extract(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """`pages` with `text`, the main text of each whole page, empty if there is none.

    Null and empty pages have empty text. Pages without a URL form one host of their own. Repeated rows repeat; a page unlike
    its host's wrapper is read by its own element names; an empty table stays empty; other columns pass through (a column named
    text makes the new one `text_`).
    """
    host = free_name(pages, "_host")
    hosted = pages.withColumn(host, host_of(F.col(url)))
    reduced = cut_lineage(_reduced(hosted.select(F.col(host).alias("host"), F.col(source).alias("html"))))
    decided = cut_lineage(decisions(reduced))
    met = _told(hosted.select(F.col(host).alias("host"), F.col(source).alias("html")), decided, "host", "host", "html", "wrapper", "known")
    names = {n: free_name(hosted, f"_{n}") for n in ("main", "template", "wrapper", "known")}
    decided = decided.join(articles(cut_lineage(_sums(met))), "host", "left")
    decided = cut_lineage(decided.select(F.col("host").alias(host), *[F.col(c).alias(n) for c, n in names.items()]))
    result = free_name(pages, "text")
    schema = T.StructType([*pages.schema.fields, T.StructField(result, T.StringType())])
    width, place = len(pages.columns), pages.columns.index(source)
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in portions(whole, place):
                columns = [batch.column(i).to_pylist() for i in (place, width, width + 1, width + 2, width + 3)]
                made = [main_text(h, m or [], t or [], w, k or []) for h, m, t, w, k in zip(*columns, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(made, pa.string())], names=[*batch.schema.names[:width], result])

    columns = [*[f"`{c}`" for c in pages.columns], *names.values()]
    return _told(hosted, decided, host, *columns).mapInArrow(over, schema)
