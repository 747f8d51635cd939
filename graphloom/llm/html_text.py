"""Main text of web pages by differencing pages with the nearest URL.

1. Within each host pages are ordered by URL path; a page's partner is the
   neighbour with the longer common path.  The order comes from a range
   exchange of ids and paths alone, so a host with a third of all pages is spread
   over many tasks; only the rows at partition borders, two a partition, meet in one.
2. Pages become lines, one per block, with a note of where each stands.
3. The lines of a page and its partner are aligned by their longest common
   subsequence, and shared lines are deleted as the host's boilerplate.  As two
   pages may carry one article, a shared line inside the article element goes only
   if pages vote for it: a page votes for its aligned lines if its article and its
   partner's share less than half of their characters, so are different ones.  The line
   needs LEAST_VOTES (one more in a folder), and half of all voters of its host or of its folder.
4. Of what is left, the lines of the article (or main) element are the text; a page
   without either, or with such elements in what stands aside alone, gives all lines that don't stand in menus, headers, footers,
   sidebars, notices, adverts, forms or comments.

Defined cases: null html counts as empty and gives an empty text; pages with a null or odd
url form a host of their own; a page without a partner keeps all lines before
step 4; repeated rows are each returned; rows with a null page_id are returned without a
partner; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import html as html_entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import bounded_batches, checkpointed, partitions, rows_in, rows_not_in, stored

OPENS = re.compile(r"<(?:!--|[/!?]|[a-zA-Z])")
QUOTE_OR_END = re.compile(r"[>\"']")
#: Elements whose content is no text.
RAW = frozenset("script style noscript template svg iframe textarea select title".split())
RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
#: Elements that don't end a line.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never belong to the text.
ASIDE = frozenset("nav footer aside form button dialog head menu fieldset".split())
#: Words in class, id or role that mark what doesn't belong to the text.
MARKED = re.compile(
    r"(?<![a-z])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent|notices?|popup|modal|overlay|newsletter|subscri\w*|sidebars?|side|menus?|nav\w*|breadcrumbs?|footers?|headers?|topbar|toolbar|masthead|comments?|respond|reply|replies|disqus|shar(?:e|ing)\w*|social\w*|related|recommend\w*|widgets?|login|signup|search\w*|pagination|pager|copyright|skip\w*|alerts?|complementary|contentinfo|hidden|visually-hidden|sr-only)(?![a-z])"
)
ATTRIBUTES = re.compile(r"""\b(class|id|role|hidden|aria-label)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
#: Closing one of these at the opening of another is implied.
CLOSED_BY = {"p": frozenset("p div ul ol li article section h1 h2 h3 h4 h5 h6 table footer nav aside header form blockquote pre main".split()), "li": frozenset({"li"}), "tr": frozenset({"tr"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "option": frozenset({"option"})}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Pages of a host that must share a line inside their articles with a different article, at least; one more of a folder, as there are many.
LEAST_VOTES = 3


def _marked(tag: str) -> bool:
    if "=" not in tag and "hidden" not in tag.lower():
        return False
    for name, *values in ATTRIBUTES.findall(tag):
        if name.lower() == "hidden":
            return True
        if name.lower() != "aria-label" and MARKED.search("".join(values).lower().replace("_", "-")):
            return True
    return False


def _tokens(html: str):
    """(start, end, tag or None, name of an element without text or None) of everything between texts, in one pass.

    A tag ends at the first > outside quotes. If that leads to the end of the page, its
    quotes, and all after it, are taken as other characters, so that no part is read again and again.
    """
    at, quotes = 0, True
    while found := OPENS.search(html, at):
        start = found.start()
        if found[0] == "<!--":
            end = html.find("-->", start + 4)
            at = len(html) if end < 0 else end + 3
            yield start, at, None, None
            continue
        end = start + 1
        while quotes:
            mark = QUOTE_OR_END.search(html, end)
            if mark is None or mark[0] == ">":
                end = -1 if mark is None else mark.start()
                break
            end = html.find(mark[0], mark.end()) + 1
            if not end:
                end = -1
                break
        if not quotes or end < 0:
            quotes = False
            end = html.find(">", start)
        if end < 0:
            # no tag ends any more; one that the page's end cuts off is no text
            last = html.rfind("<")
            if OPENS.match(html, last):
                yield last, len(html), None, None
            return
        at = end + 1
        tag = TAG.match(html, start)
        if tag and not tag[1] and tag[2].lower() in RAW:
            close = RAW_END[tag[2].lower()].search(html, at)
            at = close.end() if close else len(html)
            yield start, at, html[start : end + 1], tag[2].lower()
        else:
            yield start, at, html[start:at], None


def page_lines(html: str | None) -> list[tuple[str, bool, bool]]:
    """(line, whether it stands in the article or main element, whether it stands aside) of every block, in order."""
    lines: list[tuple[str, bool, bool]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool]] = []  # open elements; whether they begin what stands aside
    is_open: dict[str, int] = {}  # how many of a name are open, so that closing none needs no search
    aside = within = 0
    place = 0

    def end_line() -> None:
        nonlocal parts
        if parts:
            text = " ".join(html_entities.unescape("".join(parts)).split())
            parts = []
            if text:
                lines.append((text, within > 0, aside > 0))

    def close(to: int) -> None:
        nonlocal aside, within
        while len(stack) > to:
            name, is_aside = stack.pop()
            is_open[name] -= 1
            aside -= is_aside
            within -= name in ("article", "main")

    html = html or ""
    for start, end, token, raw in _tokens(html):
        if start > place:
            parts.append(html[place:start])
        place = end
        tag = TAG.match(token) if token else None
        if tag is None:
            continue
        closing, name = tag[1], tag[2].lower()
        if raw is not None:
            if name == "title":
                end_line()
            continue
        if name in INLINE:
            if name in ("br", "img", "input"):
                parts.append(" ")
            elif not closing and _marked(token):
                end_line()
                stack.append((name, True))
                is_open[name] = is_open.get(name, 0) + 1
                aside += 1
            elif closing and is_open.get(name):
                for at in range(len(stack) - 1, -1, -1):
                    if stack[at][0] == name:
                        end_line()
                        close(at)
                        break
                    if stack[at][0] not in INLINE:
                        break
            continue
        end_line()
        if closing:
            for at in range(len(stack) - 1 if is_open.get(name) else -1, -1, -1):
                if stack[at][0] == name:
                    close(at)
                    break
        elif name not in VOID and not token.endswith("/>"):
            while stack and name in CLOSED_BY.get(stack[-1][0], ()):
                close(len(stack) - 1)
            is_aside = name in ASIDE or (name == "header" and within == 0) or (name not in ("html", "body", "article", "main") and _marked(token))
            stack.append((name, is_aside))
            is_open[name] = is_open.get(name, 0) + 1
            aside += is_aside
            within += name in ("article", "main")
    if place < len(html):
        parts.append(html[place:])
    end_line()
    return lines


def common_lines(own: list, other: list) -> set[int]:
    """Places in own of a longest common subsequence; memory grows with the number of lines, not its square.

    Common ends are cut off; what lies between is halved at the place of other where the
    common lengths of both halves add up to most (Hirschberg). Lengths come from bit vectors.
    """
    shared = set(own).intersection(other)
    places = [i for i, x in enumerate(own) if x in shared]
    numbers = {x: i for i, x in enumerate(shared)}
    a, b = [numbers[own[i]] for i in places], [numbers[x] for x in other if x in shared]
    found, todo = set(), [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and a[i] == b[j]:
            found.add(places[i])
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            found.add(places[n])
        if i == n or j == m:
            continue
        if n - i == 1:
            if a[i] in b[j:m]:
                found.add(places[i])
            continue
        half = (i + n) // 2
        best = int(np.argmax(_common_lengths(a[i:half], b[j:m]) + _common_lengths(a[half:n][::-1], b[j:m][::-1])[::-1]))
        todo += [(i, half, j, j + best), (half, n, j + best, m)]
    return found


def _common_lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of a and each prefix of b, by addition of bit vectors."""
    where: dict[int, int] = {}
    for x, own in _grouped(b):
        where[x] = own
    every = (1 << len(b)) - 1
    v = every
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & every
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def _grouped(b: list[int]):
    """Each line of b with the bits of its places."""
    order = np.argsort(np.asarray(b), kind="stable")
    lines = np.asarray(b)[order]
    for own in np.split(order, np.flatnonzero(lines[1:] != lines[:-1]) + 1):
        bits = np.zeros(len(b), dtype=np.uint8)
        bits[own] = 1
        yield b[own[0]], int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def line_hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _inside(lines: list[tuple[str, bool, bool]]) -> bool:
    """Whether the text is that of an article or main element: one that stands aside (a comment, a card) is none."""
    return any(within and not aside for _, within, aside in lines)


def _chosen(lines: list[tuple[str, bool, bool]]) -> list[bool]:
    """Whether each line may be text: the article's, or all without one, that don't stand aside."""
    inside = _inside(lines)
    return [not aside and (within or not inside) for _, within, aside in lines]


def main_text(html: str | None, partner: str | None, boilerplate: set[str] | frozenset[str] = frozenset()) -> str:
    """The text of one page, given its partner's html and the lines voted out of the articles of its host."""
    lines = page_lines(html)
    gone = common_lines([x[0] for x in lines], [x[0] for x in page_lines(partner)]) if partner is not None else set()
    taken = {lines[i][0] for i in gone}
    if _inside(lines):
        taken &= boilerplate
    return " ".join(x[0] for x, may in zip(lines, _chosen(lines), strict=True) if may and x[0] not in taken)


def _neighbours(batches):
    """Rows of a sorted partition with the rows before and after, and whether a neighbour may be in another partition; three rows are held."""
    names = ["page_id", "host", "path", "part", "before_id", "before_path", "after_id", "after_path", "first", "last"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def joined(before, row, after):
        near = [x[c] if x is not None and x[1] == row[1] else None for x in (before, after) for c in (0, 2)]
        return (*row, *near, before is None, after is None)

    before = row = None
    for batch in batches:
        out = []
        for after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row is not None:
                out.append(joined(before, row, after))
            before, row = row, after
        if out:
            yield batch_of(out)
    if row is not None:
        yield batch_of([joined(before, row, None)])


def _address() -> tuple[F.Column, F.Column]:
    """Host and path of url."""
    url = F.coalesce("url", F.lit(""))
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def partners(pages: DataFrame) -> DataFrame:
    """page_id and partner_id, the page of the same host with the nearest path, of pages that have one."""
    host, path = _address()
    keys = ["host", "path", "page_id"]
    slim = pages.filter("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path")).dropDuplicates(["page_id"])
    slim = slim.repartitionByRange(partitions(pages.sparkSession), *keys).sortWithinPartitions(*keys).select("page_id", "host", "path", F.spark_partition_id().alias("part"))
    near = checkpointed(slim.mapInArrow(_neighbours, "page_id long, host string, path string, part int, before_id long, before_path string, after_id long, after_path string, first boolean, last boolean"))
    # two rows a partition at most
    order = Window.orderBy("part", F.desc("first"))
    border = near.filter("first or last").select("page_id", "host", "path", "part", "first")
    same = lambda f: f("host").over(order) == F.col("host")
    border = border.select("page_id", F.when(same(F.lag), F.struct(F.lag("page_id").over(order).alias("id"), F.lag("path").over(order).alias("path"))).alias("b"), F.when(same(F.lead), F.struct(F.lead("page_id").over(order).alias("id"), F.lead("path").over(order).alias("path"))).alias("a"))
    near = near.join(border, "page_id", "left").select("page_id", "path", *(F.coalesce(f"{x}_{y}", F.when(F.col(e), F.col(f"{x[0]}.{y}"))).alias(f"{x}_{y}") for x, e in (("before", "first"), ("after", "last")) for y in ("id", "path")))
    # where two paths first differ
    short = "least(length(path), length({x}))"
    common = lambda x: F.expr(f"if({short} = 0, 1, coalesce(nullif(array_position(transform(sequence(1, {short}), i -> substring(path, i, 1) = substring({{x}}, i, 1)), false), 0), {short} + 1))".replace("{x}", x))
    nearer = F.when(F.col("before_id").isNull(), F.col("after_id")).when(F.col("after_id").isNull(), F.col("before_id")).when(common("after_path") > common("before_path"), F.col("after_id")).otherwise(F.col("before_id"))
    return near.select("page_id", nearer.alias("partner_id")).filter("partner_id is not null")


def _line_rows(batches):
    """page_id, scopes, hashes of all lines in order, their lengths (0 if they can't be text), and whether there is an article."""
    for batch in batches:
        every, sizes, inside = [], [], []
        for page in batch.column(2):
            lines = page_lines(page.as_py())
            every.append([line_hash(x[0]) for x in lines])
            sizes.append([len(x[0]) if may else 0 for x, may in zip(lines, _chosen(lines), strict=True)])
            inside.append(_inside(lines))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(every, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32())), pa.array(inside, pa.bool_())], ["page_id", "scopes", "lines", "sizes", "inside"])


def _shared_rows(batches):
    """page_id, scopes, hashes of lines shared with the partner, inside an article and elsewhere, and whether the page votes."""
    for batch in batches:
        rows = []
        for page, scopes, lines, sizes, inside, other, other_sizes, other_inside in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            common = common_lines(lines, other)
            voter = inside and other_inside and 2 * sum(sizes[i] for i in common) < min(sum(sizes), sum(other_sizes))
            taken = {lines[i] for i in common}
            within = taken.intersection(x for x, size in zip(lines, sizes, strict=True) if size) if inside else set()
            if taken or voter:
                rows.append((page, scopes, sorted(within), sorted(taken - within), voter))
        kinds = [pa.int64(), *[pa.list_(pa.int64())] * 3, pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["page_id", "scopes", "within", "around", "voter"])


def _text_rows(batches):
    for batch in batches:
        texts = []
        gone = batch.column(3) if batch.num_columns > 3 else [None] * batch.num_rows
        for page, taken in zip(batch.column(2), gone, strict=True):
            taken = set(taken.as_py()) if taken is not None else ()
            lines = page_lines(page.as_py())
            texts.append(" ".join(x[0] for x, may in zip(lines, _chosen(lines), strict=True) if may and not (taken and line_hash(x[0]) in taken)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def _voted_out(shared: DataFrame) -> DataFrame:
    """page_id, gone: aligned lines inside articles that their host or folder votes out."""
    voters = shared.filter("voter").select("page_id", F.posexplode("scopes").alias("level", "scope"), "within").withColumn("line", F.explode_outer("within"))
    count = lambda rows, *keys: rows.select(*keys, "page_id").distinct().groupBy(*keys).agg(F.count("*").alias("n"))
    votes = count(voters.filter("line is not null"), "scope", "level", "line").filter(F.col("n") >= LEAST_VOTES + F.col("level"))
    out = votes.join(count(voters, "scope").withColumnRenamed("n", "all"), "scope").filter(2 * F.col("n") >= F.col("all")).select("scope", "line")
    aligned = shared.select("page_id", F.explode("scopes").alias("scope"), "within").select("page_id", "scope", F.explode("within").alias("line"))
    return aligned.join(out, ["scope", "line"]).groupBy("page_id").agg(F.collect_set("line").alias("voted"))


def shared_lines(pages: DataFrame) -> DataFrame:
    """page_id, gone: hashes of lines that a page loses because its partner has them, and in_text: whether the tags alone would keep one.

    Only hashes are joined, no html.
    """
    host, path = _address()
    scopes = F.array(F.xxhash64(host), F.xxhash64(host, F.regexp_extract(path, "^(.*)/", 1), F.lit("folder")))
    lines = stored(pages.filter("page_id is not null").select("page_id", scopes.alias("scopes"), "html").mapInArrow(_line_rows, "page_id long, scopes array<long>, lines array<long>, sizes array<int>, inside boolean"))
    others = lines.select(F.col("page_id").alias("partner_id"), *(F.col(x).alias(f"other_{x}") for x in ("lines", "sizes", "inside"))).dropDuplicates(["partner_id"])
    both = lines.join(partners(pages), "page_id").join(others, "partner_id").select("page_id", "scopes", "lines", "sizes", "inside", "other_lines", "other_sizes", "other_inside")
    shared = stored(both.mapInArrow(_shared_rows, "page_id long, scopes array<long>, within array<long>, around array<long>, voter boolean"))
    gone = shared.join(_voted_out(shared), "page_id", "left").select("page_id", F.array_union("around", F.coalesce("voted", F.array().cast("array<long>"))).alias("gone"))
    gone = gone.filter(F.size("gone") > 0).join(lines.select("page_id", "lines", "sizes"), "page_id")
    # what the tags leave out as well needn't be carried to the texts
    left = F.transform(F.filter(F.arrays_zip("lines", "sizes"), lambda x: x["sizes"] > 0), lambda x: x["lines"])
    return stored(gone.select("page_id", "gone", F.arrays_overlap("gone", left).alias("in_text")).dropDuplicates(["page_id"]))


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    bounded_batches(pages)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    gone = shared_lines(pages).filter("in_text").drop("in_text")
    schema = "page_id long, url string, text string, n_chars long"
    # pages that lose nothing needn't be moved
    whole = rows_not_in(pages, gone, "page_id").select("page_id", "url", "html").mapInArrow(_text_rows, schema)
    parts = rows_in(pages, gone, "page_id").join(gone, "page_id").select("page_id", "url", "html", "gone").mapInArrow(_text_rows, schema)
    return whole.unionByName(parts)
