"""Main text of web pages: suffix arrays per host find what its pages repeat outside their articles, and the elements of a page check it."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._store import store
from sparkloom.llm._text import mix, powers

#: Fixed values of HTML. RAW: their content isn't markup. SKIP: never part of the main text. BREAK: begin and end a block. VOID: have no end.
RAW = "script style noscript template textarea title iframe svg object select canvas audio video".split()
SKIP = set(RAW) | set("nav footer aside button input menu dialog head".split())
BREAK = set(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
#: An open p, li, ... ends where the next of its group begins, unless one of BOUNDS was opened after it.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
CLOSES |= {t: {"p"} for t in BREAK if t not in CLOSES}
BOUNDS = set("article aside body blockquote div dl figure footer form header html main nav ol section table ul".split())
#: Elements that class names can mark as furniture inside an article; paragraphs, lists of its own, tables and figures are its text.
CONTAINERS = set("div section header form ul ol".split())
#: Names of furniture. A class or id names it if one of these is the whole name, its last word (site-header), or its first before one of PARTS (ad-slot).
COMMENTS = set("comment comments commentlist discussion discussions disqus replies responses".split())
MARKS = COMMENTS | set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead share sharing social related recommended newsletter subscribe "
    "signup login search popup pagination alert".split()
)
PARTS = set("area bar block bottom box container form inner item items left links list panel right section slot top unit".split())
#: First words that make a name a state of its element (has-sidebar, no-ads), not what it is.
STATES = set("above after before below disable enable has hide is no non not post pre show toggle under with without".split())
ROLES = set("alert banner complementary contentinfo dialog menu menubar navigation search toolbar".split())
#: A text counts as so many characters more, so that a group has no more than hundreds of short ones.
LEAST_CHARS = 1000
#: So many hosts (some MB) are broadcast.
SMALL = 100_000
TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>|</?[a-zA-Z][^>]*\Z",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@lru_cache(100_000)
def _named(name: str) -> str:
    """What a class or id says its element is: "comments", "furniture" or nothing."""
    words = [w.lower() for w in NAME_WORD.findall(name)]
    if not words or (len(words) > 1 and words[0] in STATES):
        return ""
    if words[0] in COMMENTS or words[-1] in COMMENTS:
        return "comments"
    return "furniture" if words[-1] in MARKS or (words[0] in MARKS and words[-1] in PARTS) else ""


@lru_cache(100_000)
def _marks(rest: str) -> tuple[str, bool, bool]:
    """From an element's attributes: what its names say it is, whether it is hidden, whether its role is main."""
    found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(rest)}
    names = {_named(n) for n in f"{found.get('class', '')} {found.get('id', '')}".split()}
    role = found.get("role", "").lower()
    says = "comments" if "comments" in names else "furniture" if "furniture" in names or role in ROLES else ""
    style = found.get("style", "").lower().replace(" ", "")
    return says, "hidden" in found or "display:none" in style or "visibility:hidden" in style, role == "main"


class Page:
    """The elements of a page in the order of their starts, and its pieces of text (None: a block's edge), each with its element."""

    def __init__(self, page: str):
        self.name, self.rest, self.up, self.first, self.last = ["html"], [""], [0], [0], [0]
        self.piece: list[str | None] = []
        self.of: list[int] = []
        open_, at = [0], 0
        self.at: dict[str, list[int]] = {}  # where on the stack the open elements of a name are
        self.bounds = [0]  # where those of BOUNDS are
        for m in TAG.finditer(page):
            self._text(page[at : m.start()], open_[-1])
            at = m.end()
            name = (m["name"] or "").lower()
            if not name:
                continue
            if name in BREAK:
                self._text(None, open_[-1])
            if name == "br":
                self._text(" ", open_[-1])
            if name in VOID:
                continue
            if m["end"]:
                if self.at.get(name):
                    self._leave(open_, self.at[name][-1])
                continue
            nearest = max((self.at[e][-1] for e in CLOSES.get(name, ()) if self.at.get(e)), default=0)
            if nearest > 0 and (nearest >= self.bounds[-1] or self.name[open_[nearest]] in BOUNDS):
                self._leave(open_, nearest)
            self.name.append(name)
            self.rest.append(m["rest"])
            self.up.append(open_[-1])
            self.first.append(len(self.piece))
            self.last.append(0)
            self.at.setdefault(name, []).append(len(open_))
            if name in BOUNDS:
                self.bounds.append(len(open_))
            open_.append(len(self.name) - 1)
        self._text(page[at:], open_[-1])
        self._leave(open_, 1)
        self.last[0] = len(self.piece)

    def _text(self, s: str | None, element: int) -> None:
        if s is None or s:
            self.piece.append(s)
            self.of.append(element)

    def _leave(self, open_: list[int], depth: int) -> None:
        while len(open_) > depth:
            element = open_.pop()
            self.last[element] = len(self.piece)
            self.at[self.name[element]].pop()
            if self.bounds[-1] == len(open_):
                self.bounds.pop()


def blocks(page: str) -> tuple[list[str], bool]:
    """The text blocks of ``page`` in order, without furniture, and whether they are those of article or main elements (see ``parts``)."""
    main, _, found = parts(page)
    return main, found


def parts(page: str) -> tuple[list[str], list[str], bool]:
    """The text blocks of ``page`` in order, without furniture; the other blocks that a reader sees; whether the first are those of article or main
    elements. These are taken if they hold at least half of the text that isn't furniture; else the blocks of the whole body are. White space inside a
    block is one space.

    Furniture are the elements of SKIP, forms, labels in forms, headers outside articles, hidden elements and those whose class, id or role says so (see MARKS).
    A form, a header and an element marked by names stay where they hold an article or main element, or, on a page without one, two thirds of its text: then
    they are the page's frame (of reader comments only the article counts, as they can be longer than it). Inside an article only
    CONTAINERS can be marked by names, and its header is part of it. An article of which two thirds are links is a teaser: it is furniture beside other text.
    """
    p = Page(page)
    n = len(p.name)
    says, hidden, is_main = zip(*(_marks(r) if r else ("", False, False) for r in p.rest), strict=True)
    gone = [False] * n  # furniture in any case
    in_form, in_link, unseen = [False] * n, [False] * n, [False] * n
    for i in range(1, n):
        unseen[i] = unseen[p.up[i]] or hidden[i] or p.name[i] == "head"
        in_form[i] = in_form[p.up[i]] or p.name[i] == "form"
        in_link[i] = in_link[p.up[i]] or p.name[i] == "a"
        gone[i] = gone[p.up[i]] or p.name[i] in SKIP or hidden[i] or (p.name[i] in ("label", "fieldset") and in_form[i])
    articles = [i for i in range(1, n) if not gone[i] and (p.name[i] in ("article", "main") or is_main[i])]
    plain = [i for i in articles if not says[i]]
    weight = [0 if x is None or gone[e] else len(x) - x.count(" ") for x, e in zip(p.piece, p.of, strict=True)]
    sizes = list(accumulate(weight, initial=0))
    links = list(accumulate((w if in_link[e] else 0 for w, e in zip(weight, p.of, strict=True)), initial=0))
    of = lambda sums, i: sums[p.last[i]] - sums[p.first[i]]  # noqa: E731 - text of an element
    teasers = {i for i in plain if p.name[i] == "article" and 0 < 2 * of(sizes, i) <= 3 * of(links, i) and 2 * of(sizes, i) < sizes[-1]}
    plain = [i for i in plain if i not in teasers]
    wanted = set(plain or [i for i in articles if says[i] != "comments" and i not in teasers])
    any_wanted = any(of(sizes, i) for i in wanted)
    before = list(accumulate((i in wanted for i in range(n)), initial=0))  # wanted elements before each
    until = list(range(1, n + 1))  # the end of each element's descendants
    for i in range(n - 1, 0, -1):
        until[p.up[i]] = max(until[p.up[i]], until[i])
    inside = [False] * n
    for i in range(1, n):
        inside[i] = (inside[p.up[i]] or i in wanted) and not gone[i]
        if gone[i] or gone[p.up[i]] or i in teasers:
            gone[i] = True
            continue
        name, within = p.name[i], inside[p.up[i]]
        marked = says[i] if i not in wanted and name not in HEADINGS and name not in ("html", "body") and (not within or name in CONTAINERS) else ""
        if not (marked or name == "form" or (name == "header" and not within)):
            continue
        size = of(sizes, i)
        frame = before[until[i]] > before[i] or not any_wanted and (3 * size >= 2 * sizes[-1] if marked != "comments" else size == sizes[-1])
        gone[i] = not frame
    out: list[tuple[str, bool, bool]] = []
    words: list[str] = []
    furniture: list[str] = []
    where = False
    for s, e in [*zip(p.piece, p.of, strict=True), (None, 0)]:
        if s is None:
            for held, within, stays in ((words, where, True), (furniture, False, False)):
                text = " ".join(html.unescape("".join(held)).split())
                held.clear()
                if text:
                    out.append((text, within, stays))
        elif not gone[e]:
            words.append(s)
            where = inside[e]
        elif not unseen[e]:
            furniture.append(s)
    size = sum(len(t) for t, i, _ in out if i)
    found = 0 < size and 2 * size >= sum(len(t) for t, _, stays in out if stays)
    wanted = [(t, i if found else stays) for t, i, stays in out]
    return [t for t, w in wanted if w], [t for t, w in wanted if not w], found


def suffixes(flat: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of ``flat``, ordered to ``depth`` tokens (a power of two), and the length of the prefix that each suffix shares with the one
    before it, at most 2 * ``depth`` - 1.

    Prefix doubling gives the rank of every suffix by its first 1, 2, 4, ... tokens; common prefixes are read from these ranks, the longest step first.
    """
    n = len(flat)
    ranks = [np.unique(flat, return_inverse=True)[1].astype(np.int64)]
    step = 1
    while step < depth and ranks[-1].max(initial=0) < n - 1:
        rest = np.zeros(n, np.int64)
        rest[: max(0, n - step)] = ranks[-1][step:] + 1
        ranks.append(np.unique(ranks[-1] * (n + 2) + rest, return_inverse=True)[1].astype(np.int64))
        step *= 2
    array = np.argsort(ranks[-1], kind="stable")
    shared = np.zeros(n, np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        a, b = array[:-1] + shared[1:], array[1:] + shared[1:]
        fits = np.flatnonzero((a < n) & (b < n))
        same = fits[ranks[level][a[fits]] == ranks[level][b[fits]]]
        shared[same + 1] += 1 << level
    return array, shared


def runs_of(streams: list[list[str]], length: int) -> tuple[np.ndarray, list[int]]:
    """A number for each token of the concatenated ``streams``, alike where runs of the same ``length`` tokens begin, and where streams end.

    Each stream is followed by an end of its own. In the suffix array, suffixes that begin with the same run are neighbours, each sharing ``length`` tokens
    or more with the one before.
    """
    ids: dict[str, int] = {}
    flat, ends = [], [0]
    for tokens in streams:
        flat += [ids.setdefault(t, len(ids)) for t in tokens] + [-len(ends)]
        ends.append(len(flat))
    array, common = suffixes(np.array(flat, np.int64), 1 << max(0, length - 1).bit_length())
    run = np.zeros(len(flat), np.int64)
    run[array] = np.cumsum(common < length) - 1
    return run, ends


def on_pages(run: np.ndarray, ends: list[int], pages: list[int]) -> list[np.ndarray]:
    """For each token of each stream, on how many distinct ``pages`` its run (see ``runs_of``) stands; the streams of page -1 aren't counted."""
    page = np.repeat(np.array(pages, np.int64), np.diff(ends))
    pair = np.unique(np.stack([run, page], axis=1)[page >= 0], axis=0)
    seen = np.bincount(pair[:, 0], minlength=int(run.max(initial=-1)) + 1)[run]
    return [seen[a : b - 1] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def shared(pages: list[int], streams: list[list[str]], length: int) -> list[np.ndarray]:
    """For each token of each stream, on how many distinct ``pages`` the run of ``length`` tokens that begins there stands."""
    return on_pages(*runs_of(streams, length), pages)


def _cover(runs: np.ndarray, tokens: int, length: int) -> np.ndarray:
    """For each of ``tokens`` tokens the largest of ``runs`` (by first token) that covers it."""
    out = np.zeros(tokens, runs.dtype)
    for j in range(min(length, tokens)):
        part = runs[: tokens - j]
        out[j : j + len(part)] = np.maximum(out[j : j + len(part)], part)
    return out


def boilerplate(covered: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Which blocks, of ``sizes`` tokens, go: those at the page's beginning and end of which repeated runs cover every token. If these are more than half of the page, it is a copy and keeps all."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    whole = np.array([covered[a:b].all() for a, b in zip(ends[:-1], ends[1:], strict=True)], bool)
    first, last = np.logical_and.accumulate(whole), np.logical_and.accumulate(whole[::-1])[::-1]
    gone = first | last
    return gone if 2 * np.sum(np.array(sizes)[gone]) <= ends[-1] else np.zeros(len(sizes), bool)


def run_digests(streams: list[list[str]], length: int) -> list[np.ndarray]:
    """64-bit digests of the runs of ``length`` tokens of each stream, by first token."""
    ids: dict[str, int] = {}
    flat = np.array([ids.setdefault(t, len(ids)) for s in streams for t in s], np.int64)
    words = np.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in ids], np.uint64)[flat]
    whole = np.zeros(max(0, len(words) - length + 1), np.uint64)
    for j, m in enumerate(powers(0x2545F4914F6CDD1D, length + 1)[1:]):
        whole += words[j : j + len(whole)] * m
    ends = np.cumsum([0, *map(len, streams)])
    return [mix(whole[a : max(a, b - length + 1)]).view(np.int64) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _split(text: str) -> list[list[str]]:
    return [b.split() for b in text.split("\n\n")]


def _gone(text: str, runs: pd.Series, length: int) -> list[int]:
    """The places of the boilerplate blocks of ``text``, by the runs whose digests are in ``runs``."""
    page = _split(text)
    tokens = [w for b in page for w in b]
    covered = _cover(np.isin(run_digests([tokens], length)[0], runs), len(tokens), length)
    return np.flatnonzero(boilerplate(covered, [len(b) for b in page])).tolist()


def extract(pages: DataFrame, length: int = 8, group_chars: int = 600_000, few: int = 3, share: float = 0.02, most: float = 0.5) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html).

    All text that a reader of a host's pages sees outside of articles goes through suffix arrays: of every page its furniture and what stands beside its article, and of a page
    without one (see ``parts``) the blocks of its body. A run of ``length`` tokens is repeated if it stands in the bodies of at least ``few`` distinct such texts of the host, and
    of ``share`` of them, or outside the article on at least ``few`` distinct texts of the host, and on ``most`` of all of them.

    What is repeated goes as far as the page's elements agree. Where article and main elements hold at least half of a page's text without furniture, their text is wanted whole
    and nothing else is: it is never cut, however many pages have it, so it isn't sent to be counted, and text outside them goes, repeated or not. A block of a body goes if runs
    of repeated tokens cover it whole and only such blocks stand before it, or after it, on its page. So a passage that texts quote stays,
    and a page that would lose more than half keeps all: it is a near copy. Copies are one text to the counts, with the least of their furniture.

    A host's distinct texts are dealt to groups of about ``group_chars`` characters. The suffix array of a group gives the number of its texts by run; these numbers
    are added up by host and run, a map-side aggregate, so that the result doesn't depend on the groups. Runs are known by 64-bit digests; those that are repeated
    return to the groups whose bodies have them, and the places of the blocks that go return to the pages. Pages are parsed once, and their texts aren't shuffled unless blocks of very many go.

    Null, empty and textless pages have an empty text. Null or malformed urls are one host. Repeated rows each get their result. An
    empty table gives none; other columns are ignored.
    """
    host = F.coalesce(F.lower(F.try_parse_url(F.col("url"), F.lit("HOST"))), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            main, rest, found = zip(*(parts(h or "") for h in batch["html"]), strict=True) if len(batch) else ((), (), ())
            yield batch.drop(columns="html").assign(text=["\n\n".join(b) for b in main], rest=["\n\n".join(b) for b in rest], inside=list(found))

    def count(key: tuple, texts: pd.DataFrame) -> pd.DataFrame:
        streams = [[w for b in _split(t) for w in b] for t in (*texts["body"].fillna(""), *texts["rest"])]
        n = len(texts)
        run, ends = runs_of(streams, length)
        digests = run_digests(streams, length)
        runs, at = np.unique(np.concatenate(digests), return_index=True)
        number = lambda of: np.concatenate([s[: len(d)] for s, d in zip(on_pages(run, ends, of), digests, strict=True)])[at]
        bodies, outside = number([*range(n)] + [-1] * n), number([*range(n)] * 2)
        stay = outside >= (few if texts["alone"].iloc[0] else 1)  # no other group adds to the numbers of a host's only group
        return pd.DataFrame({"host": key[0], "part": key[1], "run": runs[stay], "bodies": bodies[stay], "outside": outside[stay]})

    def cut(key: tuple, texts: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
        gone = [_gone(t, runs["run"], length) for t in texts["body"]]
        found = [(key[0], d, g) for d, g in zip(texts["digest"], gone, strict=True) if g]
        return pd.DataFrame(found, columns=["host", "digest", "gone"], dtype=object)

    parsed = store(rows.mapInPandas(parse, "page_id long, url string, host string, text string, rest string, inside boolean"), "parsed").withColumn("digest", F.md5("text"))
    body = F.when(~F.col("inside"), F.col("text"))
    texts = store(parsed.groupBy("host", "digest").agg(F.max(body).alias("body"), F.min("rest").alias("rest")), "texts")
    least = lambda n, part: F.greatest(F.lit(few), F.ceil(n * F.lit(part)))
    chars = F.sum(F.char_length(F.coalesce("body", F.lit(""))) + F.char_length("rest") + LEAST_CHARS)
    hosts = store(texts.groupBy("host").agg(chars.alias("chars"), least(F.count("body"), share).alias("least_bodies"), least(F.count(F.lit(1)), most).alias("least_outside")), "hosts")
    large = hosts.filter(F.col("chars") > group_chars).select("host", "chars")
    large = F.broadcast(large) if large.count() <= SMALL else large  # a shuffled join of whole texts only beyond that
    groups = F.ceil(F.coalesce(F.col("chars"), F.lit(1)) / group_chars)
    part = F.pmod(F.xxhash64("digest"), groups).cast("int")
    dealt = texts.join(large, "host", "left").select("host", "digest", "body", "rest", part.alias("part"), F.col("chars").isNull().alias("alone"))
    runs = store(dealt.groupBy("host", "part").applyInPandas(count, "host string, part int, run long, bodies long, outside long"), "runs")
    repeated = (F.col("bodies") >= F.col("least_bodies")) | (F.col("outside") >= F.col("least_outside"))
    summed = runs.groupBy("host", "run").agg(F.sum("bodies").alias("bodies"), F.sum("outside").alias("outside"))
    common = summed.join(hosts.select("host", "least_bodies", "least_outside"), "host").filter(repeated).select("host", "run").hint("rebalance")
    back = runs.filter("bodies > 0").select("host", "part", "run").join(common, ["host", "run"], "left_semi")
    bare = dealt.filter(F.col("body").isNotNull()).select("host", "part", "digest", "body")
    gone = store(bare.groupBy("host", "part").cogroup(back.groupBy("host", "part")).applyInPandas(cut, "host string, digest string, gone array<int>"), "gone")
    kept = F.array_join(F.filter(F.split("text", "\n\n"), lambda b, i: ~F.array_contains("gone", i)), "\n\n")
    done = parsed.drop("rest").join(gone, ["host", "digest"], "left").withColumn("text", F.when(F.col("gone").isNull() | F.col("inside"), F.col("text")).otherwise(kept))
    return done.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
